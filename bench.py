"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmatch.operators import merge, scan
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.scan import ScanMode
from blockmatch.plans import queries as plans

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Rows of the bulk shapes: random hashes inserted, then looked up.
BULK = 1_000_000

HEADLINE = [
    "q_scan_list_expanded", "q_scan_optimized", "q_scan_count", "q_scan_approx_count", "q_find_hash", "q_histogram", "q_size", "q_sources",
    "q_add_multiple", "q_intersect", "q_intersect_hash", "q_subtract", "q_subtract_hash", "q_export_hashes", "q_import_json", "q_import_tab",
    "q_merge", "q_ingest_documents", "q_scan_documents", "q_stream_scan",
]


def _random(spark: SparkSession, n: int) -> DataFrame:
    """Events of ``n`` pseudo-random 16-byte hashes, always the same, of one source."""
    zero = F.lit(0).cast("long")
    return spark.range(n).select(
        F.unhex(F.md5(F.col("id").cast("string"))).alias("block_hash"), zero.alias("k_entropy"), F.lit("").alias("block_label"),
        F.unhex(F.lit("00")).alias("file_hash"), F.lit(1).cast("long").alias("sub_count"), F.col("id").alias("seq"),
    )


def bulk(spark: SparkSession) -> dict[str, float]:
    """Seconds of inserting and of looking up BULK hashes, random and all the same."""
    out = {}

    def timed(name: str, run) -> None:
        begun = time.time()
        run()
        out[name] = round(time.time() - begun, 3)

    held: list[BlockSet] = []
    events = _random(spark, BULK)
    timed("add_random_1m", lambda: held.append(merge.insert(events, BlockSet.empty(spark)).materialise()))
    probes = events.select(F.col("seq").alias("line"), F.lit("p").alias("label"), "block_hash")
    timed("scan_random_1m", lambda: scan.scan(held[0], probes, ScanMode.COUNT).write.format("noop").mode("overwrite").save())
    same = events.withColumn("block_hash", F.unhex(F.lit("80000000000000000000000000000000")))
    timed("add_same_1m", lambda: held.append(merge.insert(same, BlockSet.empty(spark)).materialise()))
    again = probes.withColumn("block_hash", F.unhex(F.lit("80000000000000000000000000000000")))
    timed("scan_same_1m", lambda: scan.scan(held[1], again, ScanMode.COUNT).write.format("noop").mode("overwrite").save())
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    every = plans.queries()
    every["q_histogram"](spark, SF_DIR).collect()  # starts the JVM's and the workers' engines
    for name in HEADLINE:
        begun = time.time()
        every[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begun, 3)
    took |= bulk(spark)
    rates = {f"{k}_per_s": round(BULK / v) for k, v in took.items() if k.endswith("_1m")}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
