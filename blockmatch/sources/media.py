"""Files and media images: listing, random reads, and ranges as a Spark data source."""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockmatch.functions import embedded
from blockmatch.sources.ewf import EwfImage

#: A range's length, and how much of the next one is read with it so that blocks can span both.
WINDOW = 16 << 20
OVERLAP = 1 << 20
SCHEMA = "path string, offset long, length long, filesize long, content binary"


def files_below(path: str) -> list[str]:
    """Regular files below a folder, or the file itself, in order; each inode once, later parts of multipart images left out."""
    found, seen = [], set()
    for top, _, names in os.walk(path) if os.path.isdir(path) else [(os.path.dirname(path), [], [os.path.basename(path)])]:
        for name in names:
            whole = os.path.join(top, name)
            info = os.stat(whole) if os.path.exists(whole) else None
            if info and stat.S_ISREG(info.st_mode) and (info.st_dev, info.st_ino) not in seen:
                seen.add((info.st_dev, info.st_ino))
                found.append(whole)
    return first_parts(sorted(found))


def first_parts(names: list[str]) -> list[str]:
    """Names without the ``.E02`` ... that follow an ``.E01`` of the same stem."""
    stems = {n[:-4].lower() for n in names if n[-4:].lower() == ".e01"}
    return [n for n in names if not (n[:-4].lower() in stems and re.fullmatch(r"\.[e-z][0-9a-z]{2}", n[-4:].lower()) and n[-4:].lower() != ".e01")]


class Media:
    """Random reads of a file; ``.E01`` images are read through their format, all others as they are."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.image = EwfImage(path) if path[-4:].lower() == ".e01" else None
        self.file = None if self.image else open(path, "rb")

    @property
    def size(self) -> int:
        if self.image:
            return self.image.size
        return self.file.seek(0, os.SEEK_END)

    def read(self, offset: int, count: int) -> bytes:
        if self.image:
            return self.image.read(offset, count)
        self.file.seek(offset)
        return self.file.read(count)

    def read_path(self, path: str, count: int) -> bytes:
        """Bytes at an offset, or inside archives: ``1000-zip-0``."""
        first, _, rest = path.partition("-")
        if not first.isdigit():
            raise ValueError(f"invalid path: {path}")
        if not rest:
            return self.read(int(first), count)
        return embedded.read(self.read(int(first), OVERLAP), f"0-{rest}", count)

    def hash(self) -> str:
        digest, at, size = hashlib.md5(), 0, self.size
        while at < size:
            piece = self.read(at, WINDOW)
            digest.update(piece)
            at += len(piece)
        return digest.hexdigest()

    def close(self) -> None:
        (self.image or self.file).close()


class _Range(InputPartition):
    def __init__(self, path: str, offset: int, size: int) -> None:
        self.path, self.offset, self.size = path, offset, size


class _Ranges(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        window = int(self.options.get("window", WINDOW))
        out = []
        for path in files_below(self.options["path"]):
            media = Media(path)
            size = media.size
            media.close()
            out += [_Range(path, at, size) for at in range(0, size, window)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        window, overlap = int(self.options.get("window", WINDOW)), int(self.options.get("overlap", OVERLAP))
        media = Media(partition.path)
        content = media.read(partition.offset, window + overlap)
        media.close()
        length = min(window, partition.size - partition.offset)
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.path]), pa.array([partition.offset], pa.int64()), pa.array([length], pa.int64()), pa.array([partition.size], pa.int64()), pa.array([content], pa.binary())],
            ["path", "offset", "length", "filesize", "content"],
        )


class MediaRanges(DataSource):
    """``spark.read.format("media_ranges").load(path)``: one partition for each range of each file.

    The path must be one that every executor can open.
    """

    @classmethod
    def name(cls) -> str:
        return "media_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(dict(self.options))


def ranges(spark: SparkSession, path: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    spark.dataSource.register(MediaRanges)
    return spark.read.format("media_ranges").option("window", window).option("overlap", overlap).load(path)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of all files below a path of any Spark file system, each up to 2 GB.

    ``.E01`` images are read through their format, by executors that can open their path; their later segments are no files.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(F.regexp_replace("path", "^file:/*/", "/").alias("filename"), "content")
    low, stem = F.lower("filename"), F.expr("lower(substring(filename, 1, length(filename) - 4))")
    first, later = low.endswith(".e01"), low.rlike(r"\.[e-z][0-9a-z]{2}$")
    images = rows.where(first).select("filename", stem.alias("stem"))
    plain = rows.withColumn("stem", F.when(later, stem)).where(~first).join(images.select("stem").distinct(), "stem", "left_anti").select("filename", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                media = Media(name)
                if media.size >= 1 << 31:
                    raise ValueError(f"{name}: images of 2 GB and more are read by ranges")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([media.read(0, media.size)], pa.binary())], ["filename", "content"])
                media.close()

    return plain.unionByName(images.select("filename").mapInArrow(run, "filename string, content binary"))


def expanded(rows: DataFrame, depth: int = embedded.DEPTH) -> DataFrame:
    """(filename, content, path) rows with those of all archives inside added; a child's name is ``<file>-<path>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items = [("", data or b"")]
                for path, content in embedded.expand(data or b"", depth) if depth else ():
                    items.append((path, content))
                    if sum(len(c) for _, c in items) > WINDOW:
                        yield _rows(name, items)
                        items = []
                if items:
                    yield _rows(name, items)

    def _rows(name: str, items: list[tuple[str, bytes]]) -> pa.RecordBatch:
        names = [f"{name}-{p}" if p else name for p, _ in items]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c for _, c in items], pa.binary()), pa.array([p for p, _ in items], pa.string())], ["filename", "content", "path"])

    return rows.select("filename", "content").mapInArrow(run, "filename string, content binary, path string")
