"""The operators of this subpackage, bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmatch.llm import toxicity
from blockmatch.llm.decontamination import contaminated, find_items
from blockmatch.llm.exact_dedup import exact_dedup
from blockmatch.llm.html_text import extract_main_text
from blockmatch.llm.near_dedup import near_dedup
from blockmatch.llm.packing import pack
from blockmatch.llm.pii import BASE, find_pii
from blockmatch.llm.quality import KEEP_FROM, quality
from blockmatch.llm.url_filter import filter_urls
from blockmatch.llm.warc import archive_report, read_archives, write_archives
from blockmatch.storage import materialise, new_path

URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=4, threshold=(80, 100))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), may_learn=~held_out())
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    return archive_report(materialise(read_archives(spark, path), "read-back"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    more = ["padded_length", "continued", "continues"]
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = quality(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "score", (F.col("score") >= KEEP_FROM).alias("kept"), "posterior")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, _table(spark, sf_dir, "benchmark"))
    items = F.concat_ws(",", F.transform("hits", lambda h: h["item"].cast("string")))
    return found.select("doc_id", F.size("hits").cast("long").alias("n_items"), items.alias("item_ids"), contaminated().alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from blockmatch.llm.sql import SQL

    return dict(SQL)
