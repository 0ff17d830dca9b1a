"""A training corpus from ``documents``, in five stages.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  The first four return documents with all their columns:

1. ``toxicity``: documents that the classifier scores at the threshold or above
   go; it is trained on the labelled rows among the documents it is given.
2. ``exact_dedup``: of equal texts the row with the largest doc_id stays.
3. ``near_dedup``: of each group of near copies (five-word shingles, similarity
   0.8) the row with the smallest doc_id stays.
4. ``decontamination``: documents that hold 80 % of the five-word shingles of a
   benchmark item go.
5. ``packing``: the rest is tokenised and packed; one row for each piece.

Defined results: a null text counts as empty, and all empty texts are equal; a
null doc_id ranks below every other; of rows that share a doc_id and are copies
of each other exactly one stays, and rows that share a doc_id but not their text
are documents of their own; documents without words are near copies of nothing;
an empty table passes through as an empty table; columns of any name pass
through the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmatch.llm import toxicity as toxic
from blockmatch.llm.decontamination import contaminated, find_items
from blockmatch.llm.exact_dedup import exact_dedup
from blockmatch.llm.near_dedup import near_dedup
from blockmatch.llm.packing import pack
from blockmatch.llm.queries import held_out, tokenizer_path
from blockmatch.storage import go_lean, materialise, small


def _unused(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents and a column that tells their rows apart, in the order of doc_id: doc_id itself where it does."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs, "doc_id"
    key = _unused(docs, "row_key")
    return materialise(docs.orderBy(F.col("doc_id").asc_nulls_first()).withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _only_kept(docs: DataFrame, key: str, verdicts: DataFrame, wanted: list[str]) -> DataFrame:
    dropped = materialise(verdicts.where("not kept").select(F.col(key).alias("dropped_key")), "dropped")
    return docs.join(small(dropped, 16), F.col(key) == F.col("dropped_key"), "left_anti").select(*(f"`{c}`" for c in wanted))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    go_lean(spark)  # for the whole session: the results are written by whoever called, and whole texts pass through Python
    model = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), may_learn=~held_out())
    score = _unused(docs, "score")
    return toxic.score(docs, model, score).where(F.col(score) < toxic.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs)
    return _only_kept(keyed, key, exact_dedup(keyed, id_col=key), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs)
    return _only_kept(keyed, key, near_dedup(keyed, id_col=key, shingle=5, threshold=(80, 100)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = _unused(docs, "hits")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits).where(~contaminated(hits)).drop(hits)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length", "continued", "continues")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else materialise(docs, name), sf_dir)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
