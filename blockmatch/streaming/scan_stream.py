"""Lookups on streams: packed records, stream-static joins, and first-sight state.

A packed input record is ``hash | length of label | label``, a packed result the
same followed by ``length of JSON | JSON``; lengths are 2 and 4 bytes in the
machine's order.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockmatch.functions import codec
from blockmatch.operators import scan
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.scan import ScanMode
from blockmatch.storage import materialise, new_path


def unpack(data: bytes, hash_size: int) -> tuple[list[tuple[bytes, bytes]], bool]:
    """(hash, label) records, and whether the last one was cut short (it is dropped)."""
    out, at = [], 0
    while at < len(data):
        end = at + hash_size + 2
        if end > len(data):
            return out, True
        (n,) = struct.unpack_from("=H", data, end - 2)
        if end + n > len(data):
            return out, True
        out.append((data[at : at + hash_size], data[end : end + n]))
        at = end + n
    return out, False


def pack(results: list[tuple[bytes, bytes, str]]) -> bytes:
    """Results (hash, label, JSON) as bytes."""
    return b"".join(h + struct.pack("=H", len(label)) + label + struct.pack("=I", len(raw)) + raw for h, label, text in results for raw in (text.encode(),))


def unpacked(rows: DataFrame, hash_size: int) -> DataFrame:
    """(block_hash, label) of a binary column ``data`` of packed records, on streams and tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for data in batch.column(0).to_pylist() for r in unpack(data or b"", hash_size)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["block_hash", "label"])

    return rows.select("data").mapInArrow(run, "block_hash binary, label binary")


def scan_stream(probes: DataFrame, held: BlockSet, mode: ScanMode = ScanMode.EXPANDED) -> DataFrame:
    """A stream (block_hash, label) with the JSON of what is held; each micro-batch joins the static set.

    In the optimised mode a hash is given in full when it is first seen in the stream and bare afterwards;
    the state is one row for each hash seen.

    The modes with sources write the expanded set to a table once, before the stream starts, and each micro-batch joins that.
    Where the set is much larger than what a stream asks for, ``ScanSession.sink`` expands only each batch's hashes.
    """
    short = {"block_hash": codec.json_hex("block_hash")}
    if mode is ScanMode.COUNT:
        found = held.hash.select("block_hash", codec.json_object(**short, count=F.col("count")).alias("json"))
        return probes.join(found, "block_hash")
    if mode is ScanMode.APPROXIMATE_COUNT:
        found = probes.withColumn("prefix", codec.prefix("block_hash")).join(scan.prefixes(held), "prefix")
        return found.select("block_hash", "label", codec.json_object(**short, approximate_count=codec.code_to_count("count_code")).alias("json"))
    texts = materialise(scan.expanded(held, held.hash).select("block_hash", "json"), "expanded")
    if mode is ScanMode.EXPANDED:
        return probes.join(texts, "block_hash")
    known = probes.join(held.hash.select("block_hash"), "block_hash", "left_semi")
    marked = known.groupBy("block_hash").applyInPandasWithState(_first_sight, "block_hash binary, label string, first boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    text = F.when(F.col("first"), F.col("json")).otherwise(codec.json_object(**short))
    return marked.join(texts, "block_hash").select("block_hash", "label", text.alias("json"))


def _first_sight(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
    seen = state.exists
    for rows in parts:
        rows = rows.sort_values("label", kind="stable").reset_index(drop=True)
        first = [not seen and k == 0 for k in range(len(rows))]
        seen = seen or len(rows) > 0
        yield rows.assign(first=first)[["block_hash", "label", "first"]]
    state.update((True,))


class ScanSession:
    """Batches looked up one after another, with what the session has shown kept in tables of the shared folder.

    ``put`` takes packed records and ``get`` gives the packed results of one batch, or nothing; ``empty`` says
    whether all is done.  ``look_up`` is the same on DataFrames, and serves as a ``foreachBatch`` function.
    """

    def __init__(self, held: BlockSet, hash_size: int = 16, mode: ScanMode = ScanMode.EXPANDED_OPTIMIZED) -> None:
        self.held, self.hash_size, self.mode = held, hash_size, mode
        self.spark = held.hash.sparkSession
        self.waiting: deque[bytes] = deque()
        self.shown_blocks, self.shown_files = (new_path(self.spark, n) for n in ("shown-blocks", "shown-files"))
        self.warnings: list[str] = []
        self.epoch = 0
        # What each batch was the first to show, by its number.
        for path, rows in ((self.shown_blocks, held.hash.select("block_hash")), (self.shown_files, held.source.select("file_hash"))):
            rows.limit(0).write.parquet(f"{path}/epoch=-1")

    def _shown(self, path: str, key: str, epoch: int) -> DataFrame:
        rows = self.spark.read.schema(f"{key} binary, epoch int").option("basePath", path).parquet(path)
        return rows.where(F.col("epoch") < epoch).select(key)

    def look_up(self, probes: DataFrame, epoch: int | None = None) -> DataFrame:
        """(line, label, block_hash, json) of probes (line, label, block_hash).

        ``epoch``: the batch's number, where it may come again: what it showed before doesn't count then.
        """
        if self.mode is not ScanMode.EXPANDED_OPTIMIZED:
            return scan.scan(self.held, probes, self.mode)
        blocks, files = scan.first_shown(self.held, probes)
        epoch = self.epoch if epoch is None else epoch
        self.epoch = max(self.epoch, epoch + 1)
        old_blocks, old_files = self._shown(self.shown_blocks, "block_hash", epoch), self._shown(self.shown_files, "file_hash", epoch)
        new_blocks = blocks.join(old_blocks, "block_hash", "left_anti")
        # A source is shown by the first new hash that has it.
        pairs = self.held.hash_source.join(new_blocks, "block_hash").groupBy("file_hash").agg(F.min(F.struct("line", "block_hash")).alias("first")).select("file_hash", "first.block_hash")
        new_files = pairs.join(old_files, "file_hash", "left_anti")
        texts = scan.expanded(self.held, new_blocks, new_files).select("block_hash", "json")
        first = new_blocks.withColumnRenamed("line", "first_line")
        known = probes.join(self.held.hash.select("block_hash"), "block_hash", "left_semi")
        bare = codec.json_object(block_hash=codec.json_hex("block_hash"))
        out = known.join(first, "block_hash", "left").join(texts, "block_hash", "left")
        out = out.withColumn("json", F.when(F.col("line") == F.col("first_line"), F.col("json")).otherwise(bare)).select("line", "label", "block_hash", "json")
        out = materialise(out, "looked-up")
        full = materialise(new_blocks.select("block_hash"), "new-blocks")
        shown = materialise(new_files.select("file_hash"), "new-files")
        full.write.mode("overwrite").parquet(f"{self.shown_blocks}/epoch={epoch}")
        shown.write.mode("overwrite").parquet(f"{self.shown_files}/epoch={epoch}")
        return out

    def sink(self, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: looks up each micro-batch of (line, label, block_hash)."""
        return lambda probes, epoch: write(self.look_up(probes, epoch), epoch)

    def put(self, data: bytes) -> None:
        if data:
            self.waiting.append(data)

    def get(self) -> bytes:
        while self.waiting:
            records, cut = unpack(self.waiting.popleft(), self.hash_size)
            if cut:
                self.warnings.append("record cut short; the rest of its batch is dropped")
            if not records:
                continue
            rows = [(k, label.decode("latin-1"), bytearray(h)) for k, (h, label) in enumerate(records)]
            probes = self.spark.createDataFrame(rows, "line long, label string, block_hash binary")
            found = self.look_up(probes).orderBy("line").collect()  # one batch that the caller put
            if found:
                return pack([(bytes(r["block_hash"]), r["label"].encode("latin-1"), r["json"]) for r in found])
        return b""

    def empty(self) -> bool:
        return not self.waiting
