"""Sizes, histogram, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmatch.functions import codec
from blockmatch.operators.blockset import BlockSet


def histogram(held: BlockSet) -> DataFrame:
    """(duplicates, distinct_hashes, total) for each count."""
    by = held.hash.groupBy(F.col("count").alias("duplicates")).agg(F.count("*").alias("distinct_hashes"))
    return by.select("duplicates", "distinct_hashes", (F.col("duplicates") * F.col("distinct_hashes")).alias("total"))


def totals(held: BlockSet) -> DataFrame:
    """``total_distinct_hashes`` counts the hashes seen once; ``n_distinct`` counts all."""
    return held.hash.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_hashes"),
        F.count_if(F.col("count") == 1).alias("total_distinct_hashes"),
        F.count("*").alias("n_distinct"),
    )


def duplicates(held: BlockSet, n: int) -> DataFrame:
    """Hashes with count ``n``."""
    return held.hash.where(F.col("count") == n)


def sizes(held: BlockSet) -> DataFrame:
    """Records of the five stores: a hash of one source is one record, one of more is one for each and one for itself."""
    each = held.hash_source.groupBy("block_hash").agg(F.count("*").alias("n"))
    parts = [
        each.agg(F.coalesce(F.sum(F.when(F.col("n") == 1, 1).otherwise(F.col("n") + 1)), F.lit(0)).cast("long").alias("hash_data_store"), F.countDistinct(codec.prefix("block_hash")).alias("hash_store")),
        held.source.agg(F.count("*").alias("source_data_store"), F.count("*").alias("source_id_store")),
        held.source_name.agg(F.count("*").alias("source_name_store")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    names = ["hash_data_store", "hash_store", "source_data_store", "source_id_store", "source_name_store"]
    return out.agg(*(F.max(c).alias(c) for c in names))
