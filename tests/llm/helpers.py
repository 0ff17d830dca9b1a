"""Small tables and plain versions of the operators."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, score double, hits string, id string, uid string"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows, with further columns whose names operators may use themselves."""
    return spark.createDataFrame([(i, t, "en", 1.5, "h", "x", "u") for i, t in rows], SCHEMA)


def words(rng: random.Random, n: int, kinds: int = 5000) -> list[str]:
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]
