"""Benchmark decontamination: containment search for short items in long documents.

Items of at most ``SMALLEST`` shingles are looked up exactly: each of their
shingles that a document holds makes the item a candidate.  Larger items are
partitioned by the size of their shingle sets: class ``u`` holds the sizes above
``u / 2`` up to ``u``.  For each class that has items, a document is covered by
windows of ``2 * u`` shingles, a step of ``u`` apart, so any passage of ``u``
shingles lies inside one window that is at most four times as large as the item.
The similarity of such a window to an item of which it holds 80 % is at least
0.19, and one equal MinHash coordinate of 64 is enough to make the item a
candidate: a window misses it with probability below 2e-6.  Long documents
thus cost one signature per window, not one signature that short items could
never match.  Candidates are verified by exact containment: the item's shingles
that the whole document holds, in whole numbers.

The benchmark is read in blocks of bounded size; each block's sets go to the
executors with the function, where each worker builds its index, and documents
stream past it.  A benchmark of more than one block costs one further pass over
the documents for each, with the hits so far in a written table, so driver and
executors hold one block at a time whatever the benchmark's size.

Defined results: a null or empty text, or one without words, holds nothing, and
such an item is found nowhere; an item with fewer words than a shingle is its
whole sequence, and found only in documents that are that sequence; repeated
items are found each; null ids are kept; an empty table of documents gives an
empty result, an empty benchmark no hits; ids may be of any type that can be
sorted; all columns of the documents pass through but one that has the name
asked for the hits, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from blockmatch.llm import caches
from blockmatch.llm.minhash import BITS, circulant, scattered
from blockmatch.llm.near_dedup import distinct
from blockmatch.llm.textarrays import U64, pieces, text_shingles
from blockmatch.storage import materialise

COORDINATES = 64
SMALLEST = 8
#: Shingles of items in one block, about: 8 bytes each go to every executor.
BLOCK_SHINGLES = 1 << 20
_RUN = 1 << 15

#: Bits of the filter that tells which (coordinate, value) pairs a class may have.
_FILTER = 22


def size_class(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def _spots(signatures: np.ndarray) -> np.ndarray:
    """Where each coordinate's value is in the filter."""
    return (signatures + np.arange(COORDINATES, dtype=np.uint32) * np.uint32(0x9E3779B1)) & np.uint32((1 << _FILTER) - 1)


class Index:
    """MinHash values of a block of items, by class, shingles of its small items, and the items' shingle sets."""

    def __init__(self, items: list[tuple[object, bytes]]) -> None:
        self.ids = [i for i, _ in items]
        self.sets = [np.frombuffer(s, np.uint64) for _, s in items]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
        self.small: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    def build(self) -> None:
        """Per class: a filter of the keys (coordinate, value) that items have; these keys in order, and their items.

        Small items: whether a shingle's first bits are theirs; their shingles in order, the edges of each one's items, and these items.
        """
        if self.classes is not None:
            return
        self.classes = {}
        windows, by = circulant(COORDINATES), {}
        few = [k for k, s in enumerate(self.sets) if 0 < len(s) <= SMALLEST]
        if few:
            held = np.concatenate([self.sets[k] for k in few])
            order = np.argsort(held, kind="stable")
            keys, at = np.unique(held[order], return_index=True)
            known = np.zeros(1 << BITS, bool)
            known[keys >> U64(64 - BITS)] = True
            self.small = known, keys, np.append(at, len(held)), np.repeat(np.array(few), [len(self.sets[k]) for k in few])[order]
        for k, s in enumerate(self.sets):
            if len(s) > SMALLEST:
                by.setdefault(size_class(len(s)), []).append(k)
        for u, members in by.items():
            signatures = np.array([windows[scattered(self.sets[k])].min(axis=0) for k in members])
            mask = np.zeros(1 << _FILTER, bool)
            mask[_spots(signatures)] = True
            keys = ((np.arange(COORDINATES) << BITS) + signatures.astype(np.int64)).ravel()
            order = np.argsort(keys, kind="stable")
            self.classes[u] = mask, keys[order], np.repeat(np.array(members), COORDINATES)[order]

    def small_candidates(self, shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item) pairs, as rows of two, of small items that share a shingle."""
        known, keys, edges, members = self.small
        spot = np.flatnonzero(known[shingles >> U64(64 - BITS)])
        at = np.minimum(np.searchsorted(keys, shingles[spot]), len(keys) - 1)
        same = keys[at] == shingles[spot]
        pairs = np.unique(np.column_stack([np.searchsorted(first, spot[same], "right") - 1, at[same]]), axis=0)
        a, z = edges[pairs[:, 1]], edges[pairs[:, 1] + 1]
        item = members[np.repeat(a - (np.cumsum(z - a) - (z - a)), z - a) + np.arange((z - a).sum())]
        return np.unique(np.column_stack([np.repeat(pairs[:, 0], z - a), item]), axis=0)

    def candidates(self, shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item) pairs, as rows of two, that share a coordinate in a window, or a shingle of a small item."""
        counts = np.diff(first)
        parts = -(-counts // SMALLEST)
        edge = np.concatenate([[0], np.cumsum(parts)])
        rank = np.arange(edge[-1]) - np.repeat(edge[:-1], parts)
        starts = np.repeat(first[:-1], parts) + rank * SMALLEST
        if not len(starts):
            return np.zeros((0, 2), np.int64)
        found = [self.small_candidates(shingles, first)] if self.small else []
        if self.classes:
            least = np.empty((len(starts), COORDINATES), np.uint32)
            for lo in range(0, len(starts), _RUN // SMALLEST):
                own, end = starts[lo : lo + _RUN // SMALLEST], starts[lo + _RUN // SMALLEST] if lo + _RUN // SMALLEST < len(starts) else len(shingles)
                least[lo : lo + len(own)] = np.minimum.reduceat(circulant(COORDINATES)[scattered(shingles[own[0] : end])], own - own[0], axis=0)
        for u, (mask, keys, members) in self.classes.items():
            step = u // SMALLEST
            many = np.maximum(-(-parts // step) - (parts > step), np.minimum(parts, 1))
            doc = np.repeat(np.arange(len(parts)), many)
            lo = edge[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * step
            hi = np.minimum(lo + 2 * step, edge[doc + 1])
            padded = np.concatenate([least, least[-1:]])
            window = np.minimum.reduceat(padded, np.column_stack([lo, hi]).ravel(), axis=0)[::2]
            at, k = np.nonzero(mask[_spots(window)])
            key = (k << BITS) + window[at, k].astype(np.int64)
            a, z = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            item = members[np.repeat(a - (np.cumsum(z - a) - (z - a)), z - a) + np.arange((z - a).sum())]
            found.append(np.unique(np.column_stack([doc[np.repeat(at, z - a)], item]), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def search(self, texts: pa.Array, size: int, threshold: tuple[int, int]) -> list[list[dict]]:
        self.build()
        h, first = text_shingles(texts, size)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        doc = 0
        while doc < len(texts):
            end = max(doc + 1, int(np.searchsorted(first, first[doc] + _RUN, "right")) - 1)
            pairs = self.candidates(h[first[doc] : first[end]], first[doc : end + 1] - first[doc])
            last, held = -1, None
            for d, item in pairs.tolist():
                if d != last:
                    last, held = d, distinct(h[first[doc + d] : first[doc + d + 1]])
                wanted = self.sets[item]
                spot = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                common = int((held[spot] == wanted).sum())
                if threshold[1] * common >= threshold[0] * len(wanted):
                    out[doc + d].append({"item": self.ids[item], "common": common, "size": len(wanted)})
            doc = end
        return out


def _item_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text"):
                h, first = text_shingles(rows.column(1), size)
                sets = [distinct(h[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["item", "shingles"]).filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return run


def find_items(docs: DataFrame, items: DataFrame, hits: str = "hits", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100), block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with a column ``hits``: the items held, as (item, common, size), in the order of (item, common)."""
    kept = [f for f in docs.schema.fields if f.name.lower() != hits.lower() or f.name == text_col]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    own = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    id_field = T.StructField("item", own.schema["item"].dataType)
    own = own.mapInArrow(_item_sets(shingle), T.StructType([id_field, T.StructField("shingles", T.BinaryType())]))
    own = materialise(own.withColumn("row", F.monotonically_increasing_id()), "items")
    total = own.agg(F.coalesce(F.sum(F.length("shingles") / 8), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_shingles))
    at = docs.columns.index(text_col)
    hit = T.StructType([id_field, T.StructField("common", T.LongType()), T.StructField("size", T.LongType())])
    kind = T.StructType([*kept, T.StructField(hits, T.ArrayType(hit))])
    element = to_arrow_type(T.ArrayType(hit))

    def searching(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            caches.use("decontamination")
            for batch in batches:
                for rows in pieces(batch, text_col):
                    found = index.search(rows.column(at), shingle, threshold)
                    columns = list(rows.columns)
                    if len(columns) > len(kept):
                        found = [a + b for a, b in zip(columns.pop().to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, element)], [*rows.schema.names[: len(columns)], hits])

        return run

    for block in range(blocks):
        # About ``block_shingles`` shingles at a time (items are dealt by their rows' numbers).
        part = own.where(F.pmod("row", F.lit(blocks)) == block).collect()
        docs = (materialise(docs, "searched") if block else docs).mapInArrow(searching(Index([(r["item"], bytes(r["shingles"])) for r in part])), kind)
    return docs.withColumn(hits, F.array_sort(hits))


def contaminated(hits: str = "hits") -> Column:
    return F.size(hits) > 0
