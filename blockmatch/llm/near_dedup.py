"""Near-duplicates by circulant MinHash, banding and exact Jaccard similarity.

Signature: a shingle's hash falls into one of 2 ** 22 bins.  One permutation
scatters the bins, a second gives them values, and coordinate ``k`` is the least
value over the set with the second permutation shifted circularly by ``k``: two
permutations make all 128 coordinates.  32 bands of 4 coordinates let a pair of
similarity 0.8 through with probability 1 - 5e-8.

From signatures to links:

1. Rows of equal shingle sets become one node, known by a 128-bit hash of the
   set; the rest works on nodes, so copies cost one row each.
2. Nodes that share a band's value form a bucket.  Each bucket's smallest node
   is compared with every other: as many pairs as rows, never all pairs.
   Similarity is computed on the full sets.
3. Connected components of the links found so far.  What may still be missing is
   a link between two nodes of one bucket with different labels, neither of
   which is the smallest.  Buckets of up to ``FEW`` such nodes are compared pair
   by pair; larger ones are cut into blocks of about ``BLOCK`` nodes, fewer where
   these hold more than ``BLOCK_SHINGLES`` shingles, and each
   pair of blocks is one group: a task counts shared shingles there with an
   inverted list and returns only links, at most one less than it has nodes.
4. Connected components of all links; their smallest row id.

No bucket is dropped or cut short, so every pair that shares a band is linked if
its sets say so, or is in one component already.

Defined results: a null or empty text, or one without words, has no shingles and
is linked with nothing, not even its like; a text with fewer words than a
shingle has its whole sequence as its only shingle; ``component_id`` is the
smallest id that is not null, and null if there is none; ``kept`` holds for the
rows whose id is ``component_id`` (all of them, if rows are repeated) and for
rows of null id in components without another id; an empty table gives an empty
result; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmatch.llm import caches
from blockmatch.llm.components import components
from blockmatch.llm.minhash import SEED, circulant, scattered
from blockmatch.llm.textarrays import U64, mix, pieces, text_shingles
from blockmatch.storage import materialise, small

COORDINATES = 128
ROWS = 4
BANDS = COORDINATES // ROWS
FEW = 8
BLOCK = 512
#: Shingles in a block, about; a pair of blocks takes some 100 bytes for each while it is compared.
BLOCK_SHINGLES = 1 << 18

_BAND = np.random.default_rng(SEED + 2).integers(1, 1 << 63, (1, BANDS, ROWS), dtype=np.uint64) * U64(2) + U64(1)
_BAND_NUMBER = np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    windows = circulant(COORDINATES)
    at = scattered(shingles)
    out = windows[at[:4096]].min(axis=0)
    for lo in range(4096, len(at), 4096):
        np.minimum(out, windows[at[lo : lo + 4096]].min(axis=0), out=out)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((parts * _BAND).sum(axis=2, dtype=np.uint64) + _BAND_NUMBER)


def distinct(shingles: np.ndarray) -> np.ndarray:
    s = np.sort(shingles)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, threshold: tuple[int, int]) -> np.ndarray | bool:
    """Whether common / (a + b - common) reaches the threshold, a fraction, in whole numbers."""
    return threshold[1] * common >= threshold[0] * (a + b - common)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("near_dedup")
        for batch in batches:
            for rows in pieces(batch, "text"):
                h, first = text_shingles(rows.column(1), size)
                sets = [distinct(h[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
                n = np.array([len(s) for s in sets], np.int64)
                some = n > 0
                signatures = np.array([signature(s) for s in sets if len(s)], np.uint32).reshape(-1, COORDINATES)
                bands = band_hashes(signatures).astype(np.int64).ravel()
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(n), ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands))], ["id", "text_hash", "n", "set", "bands"])

    return run


def _sets(size: int):
    """The sets of wanted nodes; a row with the node's id but another text gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text"):
                h, first = text_shingles(rows.column(0), size)
                nodes, wanted = rows.column(1).to_pylist(), rows.column(2).to_pylist()
                sets = [distinct(h[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
                out = [(node, s.tobytes()) for node, want, s in zip(nodes, wanted, sets, strict=True) if len(s) and set_id(s) == want]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "shingles"])

    return run


def _confirm(threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                keep.append(bool(linked(int((both[1:] == both[:-1]).sum()), len(a), len(b), threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def block_links(nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join the labels of nodes: between the two sides, or within the one that there is."""
    n = np.array([len(s) for s in sets], np.int64)
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(token, kind="stable")
    postings, where = owner[order], np.searchsorted(token[order], np.arange(len(values) + 1))
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    cross, out = sides.min() != sides.max(), []
    for i in range(len(sets)):
        if cross and sides[i] != sides.min():
            continue
        mine = token[start[i] : start[i + 1]]
        lo, many = where[mine], where[mine + 1] - where[mine]
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(postings[at], minlength=len(sets))
        fits = linked(common, n, n[i], threshold) & (common > 0) & (labels != labels[i])
        if cross:
            fits &= sides != sides[i]
        for j in np.flatnonzero(fits):
            x, y = find(int(labels[i])), find(int(labels[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _compare_blocks(threshold: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table["shingles"].chunks for x in chunk]
        found = block_links(table["node"].to_numpy(), table["label"].to_numpy(), table["side"].to_numpy(), sets, threshold)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(_confirm(threshold), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``docs``.

    ``threshold``: least Jaccard similarity of a link, as a fraction of whole numbers.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    id_field = T.StructField("id", docs.schema["id"].dataType)
    long = T.LongType()
    schema = T.StructType([id_field, T.StructField("text_hash", long), T.StructField("n", long), T.StructField("set", T.BinaryType()), T.StructField("bands", T.ArrayType(long))])
    rows = materialise(docs.mapInArrow(_describe(shingle), schema), "signatures")
    nodes = rows.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "set", F.col("row.id").alias("min_id"), F.col("row.text_hash").alias("min_hash"), "n", "bands"), "nodes")

    likely = f"{threshold[1]} * least(n, low_n) >= {threshold[0]} * greatest(n, low_n)"
    in_bands = nodes.select("node", "n", F.explode("bands").alias("band"))
    lowest = in_bands.groupBy("band").agg(F.min("node").alias("low"), F.min_by("n", "node").alias("low_n"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = materialise(in_bands.join(lowest, "band").where("node <> low"), "buckets")

    pairs = members.where(likely).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    shared = members.select("node").unionByName(members.select(F.col("low").alias("node"))).distinct()
    wanted = materialise(nodes.select("node", "set", "min_id", "min_hash").join(shared, "node"), "wanted")
    # A node's text is found by id and hash together: an id, or no id, that many rows share costs no more than others.
    texts = docs.join(small(wanted, 72), F.col("id").eqNullSafe(F.col("min_id")) & (F.col("text_hash") == F.col("min_hash"))).select("text", "node", "set")
    sets = texts.mapInArrow(_sets(shingle), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialise(sets, "sets")

    links = materialise(_verify(pairs, sets, threshold), "links")
    labels = components(links)

    # Cross-label pairs that no bucket's smallest node is part of.
    named = members.select("band", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("many"), F.sum("n").alias("held")).where("x <> y").select("band", "many", "held")
    rest = materialise(named.join(mixed, "band"), "mixed-buckets")
    item = F.struct("node", "label", "n")
    few = rest.where(F.col("many") <= FEW).groupBy("band").agg(F.sort_array(F.collect_list(item)).alias("items"))
    few = few.select(F.explode(F.expr(
        "flatten(transform(items, (p, i) -> transform(filter(slice(items, i + 2, size(items)), "
        f"q -> q.label <> p.label and {threshold[1]} * least(p.n, q.n) >= {threshold[0]} * greatest(p.n, q.n)), q -> struct(p.node as a, q.node as b))))"
    )).alias("pair"))
    few = _verify(few.select("pair.*").distinct(), sets, threshold)
    blocks = f"cast(greatest((many + {BLOCK - 1}) div {BLOCK}, (held + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}) as int)"
    many = rest.where(F.col("many") > FEW).withColumn("blocks", F.expr(blocks)).withColumn("side", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    many = many.join(sets, "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    many = many.select("band", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "node", "label", "side", "shingles")
    many = many.groupBy("band", "p", "q").applyInArrow(_compare_blocks(threshold), "a long, b long")
    more = materialise(few.unionByName(many), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    known = nodes.select("node", "set", "min_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("min_id").alias("component_id"))
    sets_of = known.select("set", "label").join(least, "label").select("set", "component_id")
    out = rows.select("id", "n", "set").join(sets_of, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
