"""Building a destination from other sets.

Every command copies pairs (block, source) chosen by a join with another
relation, and merges them into the destination.  Sources that the destination
held before the command are left out, and sources without blocks are never
copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmatch.operators.blockset import BlockSet, combine, of_pairs

_PAIR = ["block_hash", "file_hash"]


def _new(pairs: DataFrame, dest: BlockSet | None) -> DataFrame:
    return pairs if dest is None else pairs.join(dest.source.select("file_hash"), "file_hash", "left_anti")


def _into(dest: BlockSet | None, *more: BlockSet) -> BlockSet:
    sets = [*([dest] if dest else []), *more]
    return sets[0] if len(sets) == 1 else combine(sets)


def _of_both(a: BlockSet, b: BlockSet) -> tuple[DataFrame, DataFrame]:
    """Source data from A, else B; names from both."""
    source = a.source.unionByName(b.source.join(a.source, "file_hash", "left_anti"))
    return source, a.source_name.unionByName(b.source_name).distinct()


def add(a: BlockSet, dest: BlockSet | None = None) -> BlockSet:
    return _into(dest, of_pairs(_new(a.hash_source, dest), a.hash, a.source, a.source_name))


def add_multiple(sets: Sequence[BlockSet], dest: BlockSet | None = None) -> BlockSet:
    """All sets at once: producers may share sources; of a shared pair the first set's stays."""
    return _into(dest, *(of_pairs(_new(a.hash_source, dest), a.hash, a.source, a.source_name) for a in sets))


def _add_named(a: BlockSet, dest: BlockSet | None, which: Column) -> BlockSet:
    names = a.source_name.where(which)
    pairs = _new(a.hash_source, dest).join(names.select("file_hash").distinct(), "file_hash", "left_semi")
    return _into(dest, of_pairs(pairs, a.hash, a.source, names))


def add_repository(a: BlockSet, repository: str, dest: BlockSet | None = None) -> BlockSet:
    return _add_named(a, dest, F.col("repository_name") == repository)


def subtract_repository(a: BlockSet, repository: str, dest: BlockSet | None = None) -> BlockSet:
    return _add_named(a, dest, F.col("repository_name") != repository)


def add_range(a: BlockSet, least: int = 0, most: int = 0, dest: BlockSet | None = None) -> BlockSet:
    """Blocks whose count is at least ``least`` and, unless it is 0, at most ``most``."""
    held = a.hash.where((F.col("count") >= least) & ((F.col("count") <= most) if most else F.lit(True)))
    pairs = _new(a.hash_source, dest).join(held.select("block_hash"), "block_hash", "left_semi")
    return _into(dest, of_pairs(pairs, held, a.source, a.source_name))


def intersect(a: BlockSet, b: BlockSet, dest: BlockSet | None = None) -> BlockSet:
    """Pairs that both sets hold, as A has them."""
    pairs = _new(a.hash_source, dest).join(b.hash_source.select(_PAIR), _PAIR, "left_semi")
    return _into(dest, of_pairs(pairs, a.hash, *_of_both(a, b)))


def intersect_hash(a: BlockSet, b: BlockSet, dest: BlockSet | None = None) -> BlockSet:
    """Blocks that both sets hold, with the sources of both; A's sub-count where both have the pair."""
    shared = a.hash.select("block_hash").join(b.hash.select("block_hash"), "block_hash", "left_semi")
    both = a.hash_source.withColumn("rank", F.lit(0)).unionByName(b.hash_source.withColumn("rank", F.lit(1)))
    pairs = both.join(shared, "block_hash", "left_semi").groupBy(_PAIR).agg(F.min_by("sub_count", "rank").alias("sub_count"))
    return _into(dest, of_pairs(_new(pairs, dest), a.hash, *_of_both(a, b)))


def subtract(a: BlockSet, b: BlockSet, dest: BlockSet | None = None) -> BlockSet:
    """Pairs that only A holds."""
    pairs = _new(a.hash_source, dest).join(b.hash_source.select(_PAIR), _PAIR, "left_anti")
    return _into(dest, of_pairs(pairs, a.hash, *_of_both(a, b)))


def subtract_hash(a: BlockSet, b: BlockSet, dest: BlockSet | None = None) -> BlockSet:
    """Blocks that only A holds."""
    pairs = _new(a.hash_source, dest).join(b.hash.select("block_hash"), "block_hash", "left_anti")
    return _into(dest, of_pairs(pairs, a.hash, *_of_both(a, b)))


def repository_kinds(a: BlockSet, repository: str) -> DataFrame:
    """(file_hash, in_repository, in_other): a source can be both."""
    own = F.col("repository_name") == repository
    return a.source_name.groupBy("file_hash").agg(F.bool_or(own).alias("in_repository"), F.bool_or(~own).alias("in_other"))
