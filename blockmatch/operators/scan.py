"""Looking up block hashes, in four projections.

A probe list is (line, label, block_hash).  Lookups are equi-joins on the hash:
Spark broadcasts the smaller side by its statistics or shuffles both, and splits
hot keys.  What a list asks for repeatedly is expanded once per distinct hash.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmatch.functions import codec
from blockmatch.operators.blockset import BlockSet


class ScanMode(Enum):
    EXPANDED = "e"
    EXPANDED_OPTIMIZED = "o"
    COUNT = "c"
    APPROXIMATE_COUNT = "a"


def prefixes(held: BlockSet) -> DataFrame:
    """(prefix, count_code): the lossy store; the largest count of a prefix decides."""
    return held.hash.groupBy(codec.prefix("block_hash").alias("prefix")).agg(codec.count_to_code(F.max("count")).alias("count_code"))


def find_hash(held: BlockSet, probes: DataFrame) -> DataFrame:
    """(block_hash, k_entropy, block_label, count, source_sub_counts) of the distinct probes that are held."""
    wanted = probes.select("block_hash").distinct()
    pairs = held.hash_source.join(wanted, "block_hash", "left_semi").groupBy("block_hash").agg(F.array_sort(F.collect_list(F.struct("file_hash", "sub_count"))).alias("source_sub_counts"))
    return held.hash.join(wanted, "block_hash", "left_semi").join(pairs, "block_hash")


def count(held: BlockSet, probes: DataFrame) -> DataFrame:
    """Probes with the exact count, those not held left out."""
    return probes.join(held.hash.select("block_hash", "count"), "block_hash")


def approximate_count(held: BlockSet, probes: DataFrame) -> DataFrame:
    """Probes with the approximate count of their prefix, which another hash may have lent."""
    found = probes.withColumn("prefix", codec.prefix("block_hash")).join(prefixes(held), "prefix")
    return found.select(*probes.columns, codec.code_to_count("count_code").alias("approximate_count"))


def find_source(held: BlockSet, files: DataFrame) -> DataFrame:
    """Data of given sources (file_hash)."""
    return held.source.join(files.select("file_hash").distinct(), "file_hash", "left_semi")


def find_names(held: BlockSet, files: DataFrame) -> DataFrame:
    return held.source_name.join(files.select("file_hash").distinct(), "file_hash", "left_semi")


def has_source(held: BlockSet, file_hash: bytes) -> bool:
    return not held.source.where(F.col("file_hash") == F.lit(bytearray(file_hash))).isEmpty()


def source_fields() -> dict[str, Column]:
    """JSON members of a source with an array ``names``."""
    return {
        "file_hash": codec.json_hex("file_hash"),
        "filesize": F.col("filesize"),
        "file_type": codec.json_string("file_type"),
        "zero_count": F.col("zero_count"),
        "nonprobative_count": F.col("nonprobative_count"),
        "name_pairs": codec.json_names(F.col("names")),
    }


def with_names(source: DataFrame, source_name: DataFrame) -> DataFrame:
    """Sources with their names in order; sources without names have none."""
    names = source_name.groupBy("file_hash").agg(F.array_sort(F.collect_list(F.struct("repository_name", "filename"))).alias("names"))
    none = F.array().cast("array<struct<repository_name:string,filename:string>>")
    return source.join(names, "file_hash", "left").withColumn("names", F.coalesce("names", none))


def source_json(held: BlockSet) -> DataFrame:
    """(file_hash, json) of all sources."""
    return with_names(held.source, held.source_name).select("file_hash", codec.json_object(**source_fields()).alias("json"))


def hash_json(held: BlockSet) -> DataFrame:
    """(block_hash, json) of all hashes, as exported."""
    pairs = held.hash_source.groupBy("block_hash").agg(F.array_sort(F.collect_list(F.struct("file_hash", "sub_count"))).alias("pairs"))
    members = {
        "block_hash": codec.json_hex("block_hash"),
        "k_entropy": F.col("k_entropy"),
        "block_label": codec.json_string("block_label"),
        "source_sub_counts": codec.json_pairs(F.col("pairs")),
    }
    return held.hash.join(pairs, "block_hash").select("block_hash", codec.json_object(**members).alias("json"))


def expanded(held: BlockSet, probes: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(block_hash, json, file_hashes) of the distinct probes that are held.

    ``shown``: the pairs (block_hash, file_hash) whose source is printed in full; all, if not given.
    """
    wanted = probes.select("block_hash").distinct()
    pairs = held.hash_source.join(wanted, "block_hash", "left_semi")
    # Only pairs that are shown carry text through the shuffle by hash; those not shown have null.
    full = (pairs if shown is None else shown).select("file_hash")
    texts = source_json(BlockSet(held.hash, held.hash_source, held.source.join(full, "file_hash", "left_semi"), held.source_name.join(full, "file_hash", "left_semi")))
    if shown is None:
        pairs = pairs.join(texts, "file_hash")
    else:
        pairs = pairs.join(shown.select("block_hash", "file_hash").join(texts, "file_hash"), ["block_hash", "file_hash"], "left")
    listed = pairs.groupBy("block_hash").agg(F.array_sort(F.collect_list(F.struct("file_hash", "sub_count", "json"))).alias("pairs"))
    printed = F.transform(F.filter("pairs", lambda p: p["json"].isNotNull()), lambda p: p["json"])
    files = F.transform("pairs", lambda p: p["file_hash"])
    members = {
        "block_hash": codec.json_hex("block_hash"),
        "k_entropy": F.col("k_entropy"),
        "block_label": codec.json_string("block_label"),
        "count": F.col("count"),
        "source_list_id": codec.source_list_id(files),
        "sources": F.concat(F.lit("["), F.array_join(printed, ","), F.lit("]")),
        "source_sub_counts": codec.json_pairs(F.col("pairs")),
    }
    return held.hash.join(listed, "block_hash").select("block_hash", codec.json_object(**members).alias("json"), codec.source_list_id(files).alias("source_list_id"))


def first_shown(held: BlockSet, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where a list shows things first: (block_hash, line) and (file_hash, block_hash), by aggregations that combine before they shuffle."""
    blocks = probes.join(held.hash.select("block_hash"), "block_hash", "left_semi").groupBy("block_hash").agg(F.min("line").alias("line"))
    pairs = held.hash_source.join(blocks, "block_hash")
    return blocks, pairs.groupBy("file_hash").agg(F.min(F.struct("line", "block_hash")).alias("first")).select("file_hash", "first.block_hash")


def scan(held: BlockSet, probes: DataFrame, mode: ScanMode = ScanMode.EXPANDED_OPTIMIZED) -> DataFrame:
    """(line, label, block_hash, json) of the probes that are held; ``line`` gives their order."""
    short = {"block_hash": codec.json_hex("block_hash")}
    if mode is ScanMode.COUNT:
        out = count(held, probes).withColumn("json", codec.json_object(**short, count=F.col("count")))
    elif mode is ScanMode.APPROXIMATE_COUNT:
        out = approximate_count(held, probes).withColumn("json", codec.json_object(**short, approximate_count=F.col("approximate_count")))
    elif mode is ScanMode.EXPANDED:
        out = probes.join(expanded(held, probes), "block_hash")
    else:
        blocks, sources = first_shown(held, probes)
        texts = expanded(held, probes, sources).select("block_hash", "json")
        first = blocks.withColumnRenamed("line", "first_line")
        out = probes.join(first, "block_hash").join(texts, "block_hash")
        out = out.withColumn("json", F.when(F.col("line") == F.col("first_line"), F.col("json")).otherwise(codec.json_object(**short)))
    return out.select("line", "label", "block_hash", "json")


def lines(found: DataFrame) -> DataFrame:
    """Output lines ``label, hash, JSON`` with tabs between."""
    return found.select("line", F.concat_ws("\t", "label", codec.bin_to_hex("block_hash"), "json").alias("value"))


def hash_table(held: BlockSet, file_hash: bytes) -> DataFrame:
    """Blocks of one source: (block_hash, k_entropy, block_label, count, sub_count)."""
    own = held.hash_source.where(F.col("file_hash") == F.lit(bytearray(file_hash))).select("block_hash", "sub_count")
    return held.hash.join(own, "block_hash")


def next_key(rows: DataFrame, column: str, after: bytes | None = None) -> bytes | None:
    """The smallest key, or the smallest above ``after``."""
    rows = rows if after is None else rows.where(F.col(column) > F.lit(bytearray(after)))
    found = rows.agg(F.min(column)).first()[0]
    return None if found is None else bytes(found)
