"""Blocks along a sliding step, and their hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(rows: DataFrame, content: str, size: int, step: int, offset: Column | None = None) -> DataFrame:
    """One row for each block of a binary column: ``offset`` and ``block``, which is not padded.

    Blocks start at every multiple of ``step`` before the end.  ``offset``: where the content starts in its file.
    """
    starts = F.when(F.length(content) > 0, F.sequence(F.lit(0), F.length(content) - 1, F.lit(step)))
    out = rows.withColumn("at", F.explode(starts))
    block = F.substring(F.col(content), F.col("at") + 1, F.lit(size))
    return out.withColumn("block", block).withColumn("offset", (F.col("at") + (F.lit(0) if offset is None else offset)).cast("long")).drop("at", content)


def pad(block: Column | str, size: int) -> Column:
    """The block followed by zeros up to its size."""
    return F.rpad(F.col(block) if isinstance(block, str) else block, size, F.unhex(F.lit("00")))


def digest(block: Column | str, size: int, kind: str = "md5") -> Column:
    """Hash of the padded block: ``md5``, ``sha1`` or ``sha2``."""
    whole = pad(block, size)
    return F.unhex({"md5": F.md5, "sha1": F.sha1, "sha2": lambda c: F.sha2(c, 256)}[kind](whole))


def is_zero(block: Column | str, skip_first: bool = False) -> Column:
    """Whether all bytes are zero; ``skip_first`` doesn't look at the first."""
    c = F.col(block) if isinstance(block, str) else block
    seen = F.substring(c, F.lit(2), F.length(c)) if skip_first else c
    return seen == F.rpad(F.unhex(F.lit("")), F.length(seen), F.unhex(F.lit("00")))
