"""Blocks of files: loading them into a set, and looking them up in one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmatch.functions import blocks, embedded
from blockmatch.functions.features import block_features
from blockmatch.operators import scan
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.merge import insert
from blockmatch.sources.media import expanded
from blockmatch.storage import materialise, small


@dataclass(frozen=True)
class Options:
    block_size: int = 512
    step: int = 512
    repository: str = ""
    recursion: bool = True
    with_entropy: bool = True
    with_labels: bool = True
    #: The older rules: the first byte of a block isn't looked at for zeros.
    strict_compat: bool = False


@dataclass(frozen=True)
class Rows:
    """What files hold: events of blocks, source data and names."""

    events: DataFrame
    sources: DataFrame
    names: DataFrame


def _opened(files: DataFrame, options: Options) -> DataFrame:
    """(filename, path, content) of files and, with recursion, of the archives inside them."""
    if options.recursion:
        return expanded(files, embedded.DEPTH)
    return files.select("filename", F.coalesce("content", F.unhex(F.lit(""))).alias("content"), F.lit("").alias("path"))


def file_rows(files: DataFrame, options: Options, held: BlockSet | None = None, whitelist: BlockSet | None = None) -> Rows:
    """Events, sources and names of (filename, content) rows and of the archives inside them.

    Files of equal content are one source with several names, cut once.  Sources that ``held`` has are named but not cut.
    Content is read twice, once for the list of files and once for the blocks; both go to tables of the shared folder, so
    what follows shuffles hashes and never content.  A list of files above the broadcast limit costs a shuffle of content.
    """
    whole = _opened(files, options).withColumn("file_hash", F.unhex(F.md5("content")))
    listed = materialise(whole.select("file_hash", "filename", F.length("content").cast("long").alias("filesize")), "files")
    names = listed.select("file_hash", F.lit(options.repository).alias("repository_name"), "filename").distinct()
    new = listed
    if held is not None:
        new = new.join(held.source.select("file_hash"), "file_hash", "left_anti")
    new = new.groupBy("file_hash", "filesize").agg(F.min("filename").alias("filename"))
    wanted = small(new.select("file_hash", "filename"), F.length("filename") + 64)
    cut = blocks.cut(whole.join(wanted, ["file_hash", "filename"], "left_semi").select("file_hash", "content"), "content", options.block_size, options.step)
    cut = cut.withColumn("zero", blocks.is_zero("block", options.strict_compat))
    cut = cut.withColumn("block_hash", F.when(~F.col("zero"), blocks.digest("block", options.block_size)))
    cut = cut.withColumn("f", block_features("block", options.block_size, options.with_entropy, options.with_labels))
    cut = materialise(cut.select("file_hash", "block_hash", "f.k_entropy", "f.block_label", "offset", "zero"), "blocks")
    full = cut.where(~F.col("zero"))
    if whitelist is not None:
        full = full.join(whitelist.hash.select("block_hash", F.lit(True).alias("white")), "block_hash", "left")
        full = full.withColumn("block_label", F.when(F.col("white"), F.concat("block_label", F.lit("w"))).otherwise(F.col("block_label"))).drop("white")
    events = full.withColumn("sub_count", F.lit(1).cast("long")).withColumn("seq", F.col("offset"))
    zeros = cut.where("zero").groupBy("file_hash").agg(F.count("*").alias("zero_count"))
    flagged = events.where(F.col("block_label") != "").groupBy("file_hash").agg(F.count("*").alias("nonprobative_count"))
    nothing = F.lit(0).cast("long")
    sources = new.join(zeros, "file_hash", "left").join(flagged, "file_hash", "left")
    sources = sources.select("file_hash", "filesize", F.lit("").alias("file_type"), F.coalesce("zero_count", nothing).alias("zero_count"), F.coalesce("nonprobative_count", nothing).alias("nonprobative_count"), nothing.alias("seq"))
    return Rows(events.select("block_hash", "k_entropy", "block_label", "file_hash", "sub_count", "seq"), sources, names)


def ingest(files: DataFrame, dest: BlockSet, options: Options, whitelist: BlockSet | None = None) -> BlockSet:
    rows = file_rows(files, options, dest, whitelist)
    return insert(rows.events, dest, rows.sources, rows.names)


def media_blocks(files: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(filename, label, offset, block_hash) of all blocks that aren't zeros, and the number of those that are.

    The label is the offset, behind the path of the archive that holds the block.  The media are read once.
    """
    rows = _opened(files, options)
    cut = blocks.cut(rows.select("filename", "path", "content"), "content", options.block_size, options.step)
    cut = cut.withColumn("zero", blocks.is_zero("block", options.strict_compat))
    cut = cut.withColumn("block_hash", F.when(~F.col("zero"), blocks.digest("block", options.block_size)))
    cut = materialise(cut.drop("block"), "media-blocks")
    label = F.when(F.col("path") == "", F.col("offset").cast("string")).otherwise(F.concat_ws("-", "path", F.col("offset").cast("string")))
    probes = cut.where(~F.col("zero")).select("filename", "path", "offset", label.alias("label"), "block_hash")
    return probes, cut.agg(F.count_if("zero").alias("zero_count"))


def scan_media(files: DataFrame, held: BlockSet, options: Options, mode: scan.ScanMode = scan.ScanMode.EXPANDED_OPTIMIZED) -> tuple[DataFrame, DataFrame]:
    """Lookups of a medium's blocks as (line, label, block_hash, json), and its zero count."""
    probes, zeros = media_blocks(files, options)
    found = probes.join(held.hash.select("block_hash"), "block_hash", "left_semi")
    return scan.scan(held, found.withColumn("line", F.struct("filename", "path", "offset")).select("line", "label", "block_hash"), mode), zeros


def ranged_blocks(ranges: DataFrame, options: Options) -> DataFrame:
    """(path, offset, block_hash, zero) of blocks that start in each range of a medium (see ``sources.media.ranges``).

    Blocks start at multiples of the step from the medium's start; a block may reach into the next range's bytes.
    """
    step, size = options.step, options.block_size
    first = F.pmod(F.lit(step) - F.pmod(F.col("offset"), F.lit(step)), F.lit(step))
    starts = F.when(first < F.col("length"), F.sequence(first, F.col("length") - 1, F.lit(step).cast("long")))
    rows = ranges.withColumn("at", F.explode(starts))
    rows = rows.withColumn("block", F.substring("content", (F.col("at") + 1).cast("int"), F.lit(size)))
    return rows.select("path", (F.col("offset") + F.col("at")).alias("offset"), blocks.digest("block", size).alias("block_hash"), blocks.is_zero("block", options.strict_compat).alias("zero"))
