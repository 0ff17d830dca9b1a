"""A block set: four relations, and how rows of several sets become one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmatch import schema
from blockmatch.functions import codec
from blockmatch.storage import materialise


@dataclass(frozen=True)
class BlockSet:
    hash: DataFrame
    hash_source: DataFrame
    source: DataFrame
    source_name: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> BlockSet:
        return cls(*(spark.createDataFrame([], s) for s in (schema.HASH, schema.HASH_SOURCE, schema.SOURCE, schema.SOURCE_NAME)))

    def materialise(self) -> BlockSet:
        """The same set, written to the shared folder and read back."""
        return replace(self, **{f.name: materialise(getattr(self, f.name), f.name) for f in fields(self)})


def attributes(rows: DataFrame, order: str) -> DataFrame:
    """Per block hash, entropy and label of the row that comes first."""
    return rows.groupBy("block_hash").agg(F.min_by("k_entropy", order).alias("k_entropy"), F.min_by("block_label", order).alias("block_label"))


def with_counts(named: DataFrame, hash_source: DataFrame) -> DataFrame:
    """The hash relation of attributes and pairs."""
    counts = hash_source.groupBy("block_hash").agg(codec.saturated(F.sum("sub_count")).alias("count"))
    return named.join(counts, "block_hash").select("block_hash", "k_entropy", "block_label", "count")


def combine(sets: Sequence[BlockSet]) -> BlockSet:
    """One set: the first pair of a block and source stays, first attributes of a block, last data of a source, all names.

    The sets' order decides, not the order of rows.  Each relation is shuffled once, on its key.
    """

    def ranked(name: str) -> DataFrame:
        parts = [getattr(s, name).withColumn("rank", F.lit(k)) for k, s in enumerate(sets)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    pairs = ranked("hash_source").groupBy("block_hash", "file_hash").agg(F.min_by("sub_count", "rank").alias("sub_count"))
    data = ["filesize", "file_type", "zero_count", "nonprobative_count"]
    source = ranked("source").groupBy("file_hash").agg(*(F.max_by(c, "rank").alias(c) for c in data))
    named = attributes(ranked("hash"), "rank")
    names = ranked("source_name").select("file_hash", "repository_name", "filename").distinct()
    return BlockSet(with_counts(named, pairs), pairs, source, names)


def of_pairs(pairs: DataFrame, named: DataFrame, source: DataFrame, names: DataFrame) -> BlockSet:
    """The set of given pairs, with what belongs to their blocks and sources."""
    pairs = pairs.select("block_hash", "file_hash", "sub_count")
    cited = pairs.select("file_hash").distinct()
    return BlockSet(
        with_counts(named.select("block_hash", "k_entropy", "block_label"), pairs),
        pairs,
        source.join(cited, "file_hash", "left_semi"),
        names.join(cited, "file_hash", "left_semi"),
    )
