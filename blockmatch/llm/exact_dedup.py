"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are cut into chunks; each chunk gets the polynomial hash
``sum(byte_i * B ** (n - 1 - i)) mod p`` under two primes, all chunks of a batch
at once.  Hashes of neighbours combine without the bytes,
``H(a + b) = H(a) * B ** len(b) + H(b)``, so chunks of one huge text can be
hashed in any order and in parallel.  Texts with equal length and fingerprint
are only suspected equal: their bytes are then compared chunk by chunk, by the
least and the greatest chunk of each (fingerprint, chunk number).  Every task
combines what it has before anything is shuffled, so a group that holds a third
of all rows sends one pair of chunks a task and place, not its rows.

Defined results:

* a null text counts as the empty text, and all empty texts are equal;
* a null id ranks below every other id, and two null ids are equal;
* of equal texts the row with the largest id stays; if rows of one group also
  share that id, exactly one of them stays (``kept``), and all count in
  ``group_size``;
* texts that differ but share a fingerprint are separated by the comparison;
* other columns may have any name: only the id and the text are read;
* an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmatch.llm import caches
from blockmatch.llm.textarrays import pieces, raw
from blockmatch.storage import materialise, small

CHUNK = 4096
#: Bytes whose chunks are hashed at a time, however long a text is.
SLICE = 1 << 18
COMPARE = 1 << 16
PRIMES = (2147483647, 2147483629)
BASES = (1103515249, 1566083947)

_FP = ["fp_len", "fp_1", "fp_2"]


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n):
        out.append(out[-1] * base % prime)
    return np.array(out, np.uint64)


_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int) -> np.ndarray:
    if (base, prime) not in _tables:
        _tables[base, prime] = _power_table(base, prime, CHUNK)
    return _tables[base, prime]


def combine(left: tuple[int, int], right: tuple[int, int], base: int = BASES[0], prime: int = PRIMES[0]) -> tuple[int, int]:
    """(hash, length) of two neighbouring byte strings put together."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprints(b: np.ndarray, offsets: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Polynomial hash of each text: chunk hashes first, then combined text by text."""
    power = _powers(base, prime)
    lengths = np.diff(offsets)
    parts = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(parts)])
    rank = np.arange(first[-1]) - np.repeat(first[:-1], parts)
    starts = np.repeat(offsets[:-1], parts) + rank * CHUNK
    ends = np.minimum(starts + CHUNK, np.repeat(offsets[1:], parts))
    out = np.zeros(len(lengths), np.uint64)
    if not len(starts):
        return out
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # chunks lie end to end, so a run of them is one slice of the bytes
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
        begin, size = starts[lo], ends[lo:hi] - starts[lo:hi]
        exponent = np.repeat(ends[lo:hi] - begin, size) - 1 - np.arange(ends[hi - 1] - begin)
        hashes[lo:hi] = np.add.reduceat(power[exponent] * b[begin : ends[hi - 1]], starts[lo:hi] - begin) % np.uint64(prime)
        lo = hi
    shift = power[ends - starts]
    for k in range(int(parts.max())):
        at = np.flatnonzero(parts > k)
        c = first[at] + k
        out[at] = (out[at] * shift[c] + hashes[c]) % np.uint64(prime)
    return out


def _describe(with_text: bool, moduli: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("exact_dedup")
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "text"):
                b, offsets = raw(part.column(1))
                view = memoryview(b)
                sha = [hashlib.sha256(view[lo:hi]).hexdigest() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [
                    part.column(0),
                    pa.array(np.diff(offsets)),
                    *(pa.array(fingerprints(b, offsets, base, prime).astype(np.int64)) for base, prime in zip(BASES, moduli, strict=True)),
                    pa.array(sha, pa.string()),
                ]
                names = ["id", *_FP, "sha"]
                if with_text:
                    columns, names = [*columns, part.column(1)], [*names, "text"]
                else:
                    columns, names = [*columns, pa.array(np.arange(uid, uid + len(sha)))], [*names, "uid"]
                    uid += len(sha)
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _schema(id_type: T.DataType, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in _FP), T.StructField("sha", T.StringType()), *more])


def _unequal(docs: DataFrame, rows: DataFrame, groups: DataFrame, key: list[str], describe, schema: T.StructType) -> DataFrame:
    """(fingerprint, sha) of all rows whose group holds unequal texts, found by comparing all chunks.

    Chunks of one group and place are all equal if the least is the greatest: an aggregation that combines before it shuffles.
    """
    ids = materialise(rows.join(groups.where("n > 1").select(*key), key, "left_semi").select("id").distinct(), "suspect-ids")
    texts = docs.join(small(ids.withColumnRenamed("id", "_id"), 24), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    chunks = (
        texts.mapInArrow(describe, schema)
        .select(*key, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("bytes"))
        .withColumn("k", F.explode(F.expr(f"sequence(0, cast(greatest(length(bytes) - 1, 0) div {COMPARE} as int))")))
        .select(*key, "k", F.expr(f"substring(bytes, k * {COMPARE} + 1, {COMPARE})").alias("chunk"))
    )
    ends = chunks.groupBy(*key, "k").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    split = materialise(ends.where("least <> greatest").select(*key).distinct(), "unequal")
    return rows.join(split, key, "left_semi").select(*_FP, "sha").distinct()


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Size, largest id and one row with it, of each group; two aggregations that combine before they shuffle."""
    each = rows.groupBy(*key, "id").agg(F.count("*").alias("c"), F.min("uid").alias("u"))
    order = F.struct(F.col("id").isNotNull().alias("a"), F.col("id").alias("b"))
    if isinstance(rows.schema["id"].dataType, T.LongType | T.IntegerType):
        order = F.coalesce("id", F.lit(-(1 << 63)))
    return materialise(each.groupBy(*key).agg(F.sum("c").alias("n"), F.max("id").alias("top"), F.max_by("u", order).alias("stays")), "groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, int] = PRIMES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    ``moduli`` are the fingerprint's primes, at most 2 ** 31; smaller ones only make more work for the comparison.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType
    rows = materialise(docs.mapInArrow(_describe(False, moduli), _schema(id_type, T.StructField("uid", T.LongType()))), "fingerprints")
    key = list(_FP)
    groups = _groups(rows, key)
    read, schema = _describe(True, moduli), _schema(id_type, T.StructField("text", T.StringType()))
    odd = _unequal(docs, rows, groups, key, read, schema)
    if not odd.isEmpty():
        # Unequal texts under one fingerprint: each kind of text gets a group of its own, compared again.
        mark = odd.withColumn("variant", F.col("sha"))
        rows = materialise(rows.join(mark, [*_FP, "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit(""))), "variants")
        key = [*_FP, "variant"]
        groups = _groups(rows, key)
        split = _groups(rows.where("variant <> ''"), [*_FP, "sha"])
        if not _unequal(docs, rows.where("variant <> ''"), split, [*_FP, "sha"], read, schema).isEmpty():
            raise ValueError("texts of equal fingerprint and SHA-256 differ")
    return rows.join(groups, key).select(
        F.col("id").alias(id_col),
        F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("stays")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
