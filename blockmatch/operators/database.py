"""Block sets on disk: settings, snapshots and a log in one folder of any Spark file system.

A change writes a whole new snapshot and then a pointer of its number; the
highest pointer counts.  A snapshot is never read and overwritten at once, a
failed change leaves the old one in force, and no pointer is taken away before
the next is there.  The last two snapshots are kept, for readers of the older.  Hashes are range-partitioned and sorted, so exports and
ranges read only the files they need.
"""

from __future__ import annotations

import getpass
import json
import time
from dataclasses import asdict, dataclass, fields
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from blockmatch import __version__, schema
from blockmatch.operators import merge as merging
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.scan import next_key

_POINTER = "CURRENT."
_SORTED = {"hash": "block_hash", "hash_source": "block_hash", "source": "file_hash", "source_name": "file_hash"}
_SCHEMAS = {"hash": schema.HASH, "hash_source": schema.HASH_SOURCE, "source": schema.SOURCE, "source_name": schema.SOURCE_NAME}


@dataclass(frozen=True)
class Settings:
    settings_version: int = schema.SETTINGS_VERSION
    block_size: int = schema.BLOCK_SIZE

    def text(self) -> str:
        return json.dumps(asdict(self), separators=(", ", ":"))

    @classmethod
    def parse(cls, text: str) -> Settings:
        """The first line that isn't a comment."""
        line = next((x for x in text.splitlines() if x and not x.startswith("#")), "")
        try:
            found = json.loads(line)
            out = cls(int(found["settings_version"]), int(found["block_size"]))
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"invalid settings: {line!r}") from e
        if out.settings_version < schema.SETTINGS_VERSION:
            raise ValueError(f"settings version {out.settings_version} is too old")
        return out


class Timestamps:
    """Named stamps with the time since the last and since the first."""

    def __init__(self) -> None:
        self.first = self.last = time.monotonic()

    def stamp(self, name: str) -> str:
        now = time.monotonic()
        out = {"name": name, "delta": f"{now - self.last:.6f}", "total": f"{now - self.first:.6f}"}
        self.last = now
        return json.dumps(out, separators=(",", ":"))


class BlockDB:
    def __init__(self, spark: SparkSession, path: str, settings: Settings) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    # Small files, by Hadoop's file system so that any store will do.

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    @classmethod
    def _exists(cls, spark: SparkSession, path: str) -> bool:
        fs, at = cls._fs(spark, path)
        return fs.exists(at)

    def _read(self, name: str) -> str:
        fs, at = self._fs(self.spark, f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """The file appears whole: it is written under another name and moved."""
        fs, at = self._fs(self.spark, f"{self.path}/{name}.new")
        stream = fs.create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, target = self._fs(self.spark, f"{self.path}/{name}")
        fs.delete(target, False)
        fs.rename(at, target)

    @classmethod
    def create(cls, spark: SparkSession, path: str, settings: Settings = Settings(), command: str = "") -> BlockDB:
        if cls._exists(spark, path):
            raise FileExistsError(f"Path '{path}' already exists")
        db = cls(spark, path, settings)
        fs, at = cls._fs(spark, path)
        fs.mkdirs(at)
        db._write("settings.json", settings.text() + "\n")
        db._save(BlockSet.empty(spark), 0)
        db.log(command, ["created"])
        return db

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BlockDB:
        if not cls._exists(spark, f"{path.rstrip('/')}/settings.json"):
            raise FileNotFoundError(f"no block database at '{path}'")
        db = cls(spark, path, Settings())
        db.settings = Settings.parse(db._read("settings.json"))
        return db

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, like: BlockDB, command: str = "") -> BlockDB:
        """The database, made with another's settings if it is new."""
        return cls.open(spark, path) if cls._exists(spark, path) else cls.create(spark, path, like.settings, command)

    def write_settings(self, settings: Settings) -> None:
        self._write("_old_settings.json", self._read("settings.json"))
        self._write("settings.json", settings.text() + "\n")
        self.settings = settings

    @property
    def snapshot(self) -> int:
        return max(self._pointers())

    def _pointers(self) -> list[int]:
        fs, at = self._fs(self.spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[len(_POINTER) :]) for n in names if n.startswith(_POINTER) and n[len(_POINTER) :].isdigit())

    def blocks(self) -> BlockSet:
        at = f"{self.path}/{self.snapshot:08d}"
        return BlockSet(**{name: self.spark.read.schema(kind).parquet(f"{at}/{name}") for name, kind in _SCHEMAS.items()})

    def _save(self, held: BlockSet, number: int) -> None:
        for f in fields(held):
            key = _SORTED[f.name]
            rows = getattr(held, f.name).select(_SCHEMAS[f.name].fieldNames())
            rows = rows.repartitionByRange(key).sortWithinPartitions(key) if number else rows
            rows.write.mode("overwrite").parquet(f"{self.path}/{number:08d}/{f.name}")
        self._write(f"{_POINTER}{number:08d}", "")
        for old in self._pointers()[:-2]:
            for name in (f"{_POINTER}{old:08d}", f"{old:08d}"):
                fs, at = self._fs(self.spark, f"{self.path}/{name}")
                fs.delete(at, True)

    def save(self, held: BlockSet, command: str = "", counters: dict[str, int] | None = None) -> None:
        """A new snapshot, and what changed to the log."""
        self._save(held, self.snapshot + 1)
        self.log(command, merging.report(counters or {}))

    def log(self, command: str, lines: list[str]) -> None:
        old = self._read("log.txt") if self._exists(self.spark, f"{self.path}/log.txt") else ""
        head = [f"# command: {command}", f"# version: {__version__}, user: {getpass.getuser()}, {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"]
        self._write("log.txt", old + "\n".join([*head, *lines]) + "\n")

    def insert(self, events, sources=None, names=None, command: str = "") -> dict[str, int]:
        return self._change(merging.insert, "insert", events, sources, names, command)

    def merge(self, events, sources=None, names=None, command: str = "") -> dict[str, int]:
        return self._change(merging.merge, "merge", events, sources, names, command)

    def _change(self, how, mode: str, events, sources, names, command: str) -> dict[str, int]:
        held = self.blocks()
        counters = merging.changes(events, held, mode, sources, names).first().asDict()
        self.save(how(events, held, sources, names), command, counters)
        return counters

    def first_hash(self) -> bytes | None:
        return next_key(self.blocks().hash, "block_hash")

    def next_hash(self, after: bytes) -> bytes | None:
        held = self.blocks().hash
        if held.where(F.col("block_hash") == F.lit(bytearray(after))).isEmpty():
            raise KeyError(after.hex())
        return next_key(held, "block_hash", after)

    def first_source(self) -> bytes | None:
        return next_key(self.blocks().source, "file_hash")

    def next_source(self, after: bytes) -> bytes | None:
        held = self.blocks().source
        if held.where(F.col("file_hash") == F.lit(bytearray(after))).isEmpty():
            raise KeyError(after.hex())
        return next_key(held, "file_hash", after)
