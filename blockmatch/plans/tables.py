"""Block sets over the driver's tables.

Blocks are parts and sources are orders: a line item is one occurrence of its
part's hash in its order.  Queries over one set have all line items.  Sets A and
B hold them all together: they share the middle line numbers, and one in sixteen
blocks, by its hash, is whole in one of them and absent from the other.  They
differ in attributes, source data and file names, so that it shows whose value a
command keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmatch.functions import codec
from blockmatch.operators.blockset import BlockSet, of_pairs

_FIRST = "substr(md5(CAST(l_partkey AS VARCHAR(20))), 1, 1)"
#: Conditions on line items, in words that Spark and DuckDB share.
ALL = "true"
IN_A = f"(l_linenumber <= 4 OR {_FIRST} = '0') AND {_FIRST} <> 'f'"
IN_B = f"(l_linenumber >= 3 OR {_FIRST} = 'f') AND {_FIRST} <> '0'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str) -> Column:
    return F.unhex(F.md5(F.col(column).cast("string")))


def block_set(spark: SparkSession, sf_dir: str, which: str = ALL) -> BlockSet:
    """The set of the line items that ``which`` names."""
    items, second = table(spark, sf_dir, "lineitem").where(which), which == IN_B
    counted = items.groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n"))
    pairs = counted.select(key("l_partkey").alias("block_hash"), key("l_orderkey").alias("file_hash"), codec.sub_count("n").alias("sub_count"))
    parts = items.select("l_partkey").distinct()
    entropy = F.pmod(F.col("l_partkey") * 37, F.lit(8001)) + (10000 if second else 0)
    mark = F.when(F.col("l_partkey") % 10 == 0, "H" if second else "W").otherwise("")
    named = parts.select(key("l_partkey").alias("block_hash"), entropy.alias("k_entropy"), mark.alias("block_label"))
    orders = table(spark, sf_dir, "orders").withColumn("file_hash", key("o_orderkey"))
    size = F.floor("o_totalprice").cast("long") + (1000000 if second else 0)
    source = orders.select("file_hash", size.alias("filesize"), F.col("o_orderstatus").alias("file_type"), (F.col("o_custkey") % 5).alias("zero_count"), (F.col("o_orderkey") % 7).alias("nonprobative_count"))
    file = F.concat(F.lit("b_order_" if second else "order_"), F.col("o_orderkey").cast("string")).alias("filename")
    names = orders.select("file_hash", F.col("o_orderpriority").alias("repository_name"), file)
    names = names.unionByName(orders.select("file_hash", F.concat(F.lit("status_"), "o_orderstatus").alias("repository_name"), file))
    return of_pairs(pairs, named, source, names)


def flat(held: BlockSet) -> DataFrame:
    """One row for each pair, with all that the set says of its block and source."""
    names = held.source_name.groupBy("file_hash").agg(F.count("*").alias("n_names"), F.min("filename").alias("first_name"))
    rows = held.hash_source.join(held.hash, "block_hash").join(held.source, "file_hash").join(names, "file_hash", "left")
    return rows.select(
        codec.bin_to_hex("block_hash").alias("block_hash"), codec.bin_to_hex("file_hash").alias("file_hash"), "sub_count", "k_entropy", "block_label", "count",
        "filesize", "file_type", "zero_count", "nonprobative_count", F.coalesce("n_names", F.lit(0)).alias("n_names"), "first_name",
    )


def events(held: BlockSet) -> DataFrame:
    """A set's pairs as events of a merge."""
    named = held.hash.select("block_hash", "k_entropy", "block_label")
    return held.hash_source.join(named, "block_hash").withColumn("seq", F.lit(0).cast("long"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, as a probe list."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("label"), key("p_partkey").alias("block_hash"))


def repeated_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items, as a probe list that repeats its hashes."""
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.col("l_returnflag").alias("label"), key("l_partkey").alias("block_hash"))
