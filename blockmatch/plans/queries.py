"""The engine's operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmatch.functions import blocks, codec
from blockmatch.functions.features import block_features
from blockmatch.operators import ingest, merge, scan, setops, stats
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.scan import ScanMode
from blockmatch.plans.tables import IN_A, IN_B, block_set, events, flat, key, probes, repeated_probes, table
from blockmatch.sources import lists
from blockmatch.storage import materialise, new_path
from blockmatch.streaming.scan_stream import ScanSession, scan_stream

#: Ends of the exported range.
RANGE = ("40", "80ffffffffffffffffffffffffffffff")
REPOSITORY = "1-URGENT"
ORDER = b"1"
#: A count that some blocks have, and a range of counts.
COUNT, COUNTS = 31, (20, 31)


def _hex() -> Column:
    return codec.bin_to_hex("block_hash").alias("block_hash")


def _both(spark: SparkSession, sf_dir: str) -> tuple[BlockSet, BlockSet]:
    return block_set(spark, sf_dir, IN_A), block_set(spark, sf_dir, IN_B)


def _without_id(text: str = "json") -> Column:
    """JSON without the member that DuckDB can't compute in a bearable time."""
    return F.regexp_replace(text, '"source_list_id":[0-9]+,', "").alias("json")


# Lookups.


def q_scan_list_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(block_set(spark, sf_dir), probes(spark, sf_dir), ScanMode.EXPANDED)
    return found.select("line", "label", _hex(), _without_id())


def q_scan_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(block_set(spark, sf_dir), repeated_probes(spark, sf_dir), ScanMode.EXPANDED_OPTIMIZED)
    return found.select("line", "label", _hex(), _without_id())


def q_scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(block_set(spark, sf_dir), repeated_probes(spark, sf_dir), ScanMode.COUNT).select("line", "label", _hex(), "json")


def q_scan_approx_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(block_set(spark, sf_dir), repeated_probes(spark, sf_dir), ScanMode.APPROXIMATE_COUNT).select("line", "label", _hex(), "json")


def q_find_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.find_hash(block_set(spark, sf_dir), probes(spark, sf_dir))
    return found.select(_hex(), "k_entropy", "block_label", "count", F.size("source_sub_counts").cast("long").alias("n_sources"), codec.json_pairs(F.col("source_sub_counts")).alias("source_sub_counts"))


def q_find_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(key("o_orderkey").alias("file_hash"))
    found = scan.find_source(block_set(spark, sf_dir), files)
    return found.select(codec.bin_to_hex("file_hash").alias("file_hash"), "filesize", "file_type", "zero_count", "nonprobative_count")


def q_find_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(key("o_orderkey").alias("file_hash"))
    return scan.find_names(block_set(spark, sf_dir), files).withColumn("file_hash", codec.bin_to_hex("file_hash"))


def q_hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    return scan.hash_table(block_set(spark, sf_dir), hashlib.md5(ORDER).digest()).withColumn("block_hash", codec.bin_to_hex("block_hash"))


# Statistics.


def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicates(block_set(spark, sf_dir), COUNT).withColumn("block_hash", codec.bin_to_hex("block_hash"))


def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(block_set(spark, sf_dir))


def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(block_set(spark, sf_dir))


def q_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sizes(block_set(spark, sf_dir))


def q_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.source_json(block_set(spark, sf_dir)).withColumn("file_hash", codec.bin_to_hex("file_hash"))


# Destinations built from other sets.


def q_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _both(spark, sf_dir)
    return flat(setops.add(a, b))


def q_add_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.add_multiple(_both(spark, sf_dir)))


def q_add_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.add_repository(block_set(spark, sf_dir), REPOSITORY))


def q_subtract_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.subtract_repository(block_set(spark, sf_dir), REPOSITORY))


def q_add_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.add_range(block_set(spark, sf_dir), *COUNTS))


def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.intersect(*_both(spark, sf_dir)))


def q_intersect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.intersect_hash(*_both(spark, sf_dir)))


def q_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.subtract(*_both(spark, sf_dir)))


def q_subtract_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(setops.subtract_hash(*_both(spark, sf_dir)))


def q_repository_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.repository_kinds(block_set(spark, sf_dir), REPOSITORY).withColumn("file_hash", codec.bin_to_hex("file_hash"))


# Export and import.


def q_export_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.hash_json(block_set(spark, sf_dir)).withColumn("block_hash", codec.bin_to_hex("block_hash"))


def q_export_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lists.export_json(block_set(spark, sf_dir), *(bytes.fromhex(x) for x in RANGE))
    return rows.select("kind", codec.bin_to_hex("key").alias("key"), "value")


def q_import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set exported as JSON lines and imported again."""
    lines = materialise(lists.export_json(block_set(spark, sf_dir)).select(F.monotonically_increasing_id().alias("line"), "value"), "exported")
    parsed = lists.parse_json(lines)
    return flat(merge.merge(parsed.events, BlockSet.empty(spark), parsed.sources, parsed.names))


def _tab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    value = F.concat_ws("\t", F.md5(F.col("l_orderkey").cast("string")), F.md5(F.col("l_partkey").cast("string")), (F.col("l_linenumber") * 512).cast("string"))
    return items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), value.alias("value"))


def q_import_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = lists.parse_tab(_tab_lines(spark, sf_dir), "tab", "lineitem.tab")
    return flat(merge.insert(parsed.events, BlockSet.empty(spark), parsed.sources, parsed.names))


def q_import_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _both(spark, sf_dir)
    parsed = lists.parse_tab(_tab_lines(spark, sf_dir), "tab", "lineitem.tab", held=a, whitelist=b)
    return flat(merge.insert(parsed.events, BlockSet.empty(spark), parsed.sources, parsed.names))


def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B's rows merged into A: A's pairs and attributes stay, B's source data win."""
    a, b = _both(spark, sf_dir)
    return flat(merge.merge(events(b), a, b.source.withColumn("seq", F.lit(0).cast("long")), b.source_name))


def q_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B's rows inserted into A: sub-counts add up."""
    a, b = _both(spark, sf_dir)
    return flat(merge.insert(events(b), a, b.source.withColumn("seq", F.lit(0).cast("long")), b.source_name))


def q_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _both(spark, sf_dir)
    counted = merge.changes(events(b), a, "merge", b.source.withColumn("seq", F.lit(0).cast("long")), b.source_name)
    return counted.drop("hash_count_changed", "hash_count_not_changed")


# Blocks and their features.


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), "lang")


def q_blocks_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = blocks.cut(_documents(spark, sf_dir).drop("lang"), "content", 512, 512)
    return cut.select("filename", "offset", F.lower(F.hex(blocks.digest("block", 512))).alias("block_hash"))


def q_zero_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero blocks of documents that 1500 zero bytes follow."""
    docs = _documents(spark, sf_dir).select("filename", F.concat("content", F.unhex(F.lit("00" * 1500))).alias("content"))
    cut = blocks.cut(docs, "content", 512, 512)
    return cut.groupBy("filename").agg(F.count_if(blocks.is_zero("block")).alias("zero_count"), F.count("*").alias("blocks"))


def q_block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = blocks.cut(_documents(spark, sf_dir).drop("lang"), "content", 512, 512).withColumn("f", block_features("block", 512))
    return cut.select("filename", "offset", "f.k_entropy", "f.block_label")


_PLAIN = ingest.Options(repository="documents", recursion=False, with_entropy=False, with_labels=False)


def q_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _documents(spark, sf_dir).select("filename", "content")
    return flat(ingest.ingest(files, BlockSet.empty(spark), _PLAIN))


def q_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents looked up among the blocks of the English ones."""
    docs = _documents(spark, sf_dir)
    held = ingest.ingest(docs.where("lang = 'en'").select("filename", "content"), BlockSet.empty(spark), _PLAIN)
    found, _ = ingest.scan_media(docs.select("filename", "content"), held, _PLAIN, ScanMode.COUNT)
    return found.select(F.col("line.filename").alias("filename"), "label", _hex(), "json")


# Functions.


def q_hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and broken hexadecimal texts."""
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.upper(F.md5(F.col("o_orderkey").cast("string"))), F.when(F.col("o_orderkey") % 4 == 1, "a").when(F.col("o_orderkey") % 4 == 2, "zz").otherwise(""))
    return orders.select("o_orderkey", codec.bin_to_hex(codec.hex_to_bin(text)).alias("hex"))


def q_prefix7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.bin_to_hex(codec.prefix(key("o_orderkey"))).alias("prefix"))


def q_approx_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.count_to_code(count).alias("code"), codec.approximate_count(count).alias("approximate_count"))


def q_source_list_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = block_set(spark, sf_dir)
    return scan.expanded(held, probes(spark, sf_dir)).select(_hex(), "source_list_id")


# Streams.


def _event_set(spark: SparkSession, sf_dir: str) -> BlockSet:
    rows = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    pairs = rows.select(key("event_type").alias("block_hash"), key("user_id").alias("file_hash"), F.col("n").alias("sub_count"), zero.alias("k_entropy"), F.lit("").alias("block_label"), F.lit(0).cast("long").alias("seq"))
    return merge.merge(pairs, BlockSet.empty(spark))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of probes, all of the table."""
    stored = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.select("event_id", F.col("event_id").cast("string").alias("label"), key("event_type").alias("block_hash"))


def _run(stream: DataFrame, spark: SparkSession, schema: str) -> DataFrame:
    out = new_path(spark, "stream-out")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream-state"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def q_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _event_set(spark, sf_dir).materialise()
    found = scan_stream(_event_stream(spark, sf_dir).drop("event_id"), held, ScanMode.COUNT)
    return _run(found, spark, "block_hash binary, label string, json string").select("label", _hex(), "json")


def q_stream_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each hash is given in full and bare, by a session that looks up micro-batches."""
    session = ScanSession(_event_set(spark, sf_dir).materialise())
    out = new_path(spark, "session-out")

    def write(found: DataFrame, epoch: int) -> None:
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = _event_stream(spark, sf_dir).withColumnRenamed("event_id", "line")
    query = stream.writeStream.foreachBatch(session.sink(write)).option("checkpointLocation", new_path(spark, "session-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("line long, label string, block_hash binary, json string, epoch int").option("basePath", out).parquet(out)
    full = F.col("json").contains("source_sub_counts")
    return found.groupBy(_hex()).agg(F.count_if(full).alias("full"), F.count_if(~full).alias("bare"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("q_") and callable(f)}
