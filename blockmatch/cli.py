"""Command line: ``python -m blockmatch.cli COMMAND [options] ARGUMENTS``."""

from __future__ import annotations

import argparse
import os
import shlex
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmatch.functions import codec
from blockmatch.operators import ingest, merge, scan, setops, stats
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.database import BlockDB, Settings
from blockmatch.operators.scan import ScanMode
from blockmatch.sources import lists
from blockmatch.sources.media import Media, contents
from blockmatch.streaming.scan_stream import ScanSession

SAME = "80000000000000000000000000000000"


def _range(text: str) -> tuple[int, int]:
    """``m:n``, either side may be empty."""
    least, _, most = text.partition(":")
    return int(least or 0), int(most or 0)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="blockmatch")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, options: str = "", about: str = "", many: bool = False) -> None:
        p = commands.add_parser(name, help=about)
        for a in arguments:
            p.add_argument(a, **({"nargs": "+"} if many and a == arguments[-1] else {}))
        for o in options:
            if o == "b":
                p.add_argument("-b", "--block-size", type=int, default=512)
            elif o == "s":
                p.add_argument("-s", "--step", type=int)
            elif o == "r":
                p.add_argument("-r", "--repository")
            elif o == "w":
                p.add_argument("-w", "--whitelist")
            elif o == "x":
                p.add_argument("-x", "--disable", default="", help="r: recursion, e: entropy, l: labels")
            elif o == "j":
                p.add_argument("-j", "--json-mode", choices=[m.value for m in ScanMode], default="o")
            elif o == "p":
                p.add_argument("-p", "--part", help="begin:end of the hashes, hexadecimal, both inclusive")

    add("create", "db", options="b", about="make an empty database")
    add("ingest", "db", "path", options="srwx", about="load blocks of files")
    add("import_tab", "db", "file", options="rw", about="load a tab list")
    add("import", "db", "file", about="load JSON lines")
    add("export", "db", "file", options="p", about="write JSON lines")
    add("add", "a", "dest")
    add("add_multiple", "databases", many=True, about="all but the last go into the last")
    add("add_repository", "a", "dest", "repository")
    add("add_range", "a", "dest", "range", about="counts m:n")
    for name in ("intersect", "intersect_hash", "subtract", "subtract_hash"):
        add(name, "a", "b", "dest")
    add("subtract_repository", "a", "dest", "repository")
    add("scan_list", "db", "file", options="j", about="look up a list of hashes")
    add("scan_hash", "db", "hash", options="j")
    add("scan_media", "db", "path", options="sxj", about="look up blocks of a medium")
    add("size", "db")
    add("sources", "db")
    add("histogram", "db")
    add("duplicates", "db", "count", options="j")
    add("hash_table", "db", "file_hash", options="j")
    add("read_media", "path", "offset", "count", about="bytes at an offset or a path such as 1000-zip-0")
    add("read_media_size", "path")
    for name in ("add_random", "scan_random", "add_same", "scan_same", "test_scan_stream"):
        add(name, "db", "count", options="j" if "scan" in name else "")
    return top


def _binary(text: str) -> bytes:
    try:
        return bytes.fromhex(text) if text else b""
    except ValueError:
        return b""


def _lines(spark: SparkSession, file: str) -> DataFrame:
    """Lines of a file, or of standard input for ``-``."""
    return lists.of_lines(spark, sys.stdin.read().splitlines()) if file == "-" else lists.read_lines(spark, file)


def _show(rows: DataFrame, column: str = "value") -> None:
    for r in rows.toLocalIterator():
        print(r[column])


def _into(spark: SparkSession, dest: str, like: BlockDB, build, command: str) -> None:
    db = BlockDB.open_or_create(spark, dest, like, command)
    db.save(build(db.blocks()), command)


def _random(spark: SparkSession, n: int, same: bool) -> DataFrame:
    hash_ = F.lit(SAME) if same else F.md5(F.concat(F.lit("random "), F.col("id").cast("string")))
    zero = F.lit(0).cast("long")
    return spark.range(n).select(F.unhex(hash_).alias("block_hash"), zero.alias("k_entropy"), F.lit("").alias("block_label"), F.unhex(F.lit("00")).alias("file_hash"), F.lit(1).cast("long").alias("sub_count"), F.col("id").alias("seq"))


def run(spark: SparkSession, argv: list[str]) -> int:
    a = _parser().parse_args(argv)
    command = shlex.join(["blockmatch", *argv])
    mode = ScanMode(getattr(a, "json_mode", "o"))

    def opened(path: str) -> BlockDB:
        return BlockDB.open(spark, path)

    def report(counters: dict[str, int]) -> None:
        print("\n".join(merge.report(counters)))

    if a.command == "create":
        BlockDB.create(spark, a.db, Settings(block_size=a.block_size), command)
        print("New database created.")
    elif a.command in ("ingest", "scan_media"):
        db = opened(a.db)
        options = ingest.Options(
            block_size=db.settings.block_size, step=a.step or db.settings.block_size, repository=getattr(a, "repository", None) or a.path,
            recursion="r" not in a.disable, with_entropy="e" not in a.disable, with_labels="l" not in a.disable,
        )
        files = contents(spark, a.path)
        if a.command == "ingest":
            rows = ingest.file_rows(files, options, db.blocks(), opened(a.whitelist).blocks() if a.whitelist else None)
            report(db.insert(rows.events, rows.sources, rows.names, command))
        else:
            found, zeros = ingest.scan_media(files, db.blocks(), options, mode)
            _show(scan.lines(found).orderBy("line"))
            print(f"# {zeros.first()[0]} zero blocks")
    elif a.command == "import_tab":
        db = opened(a.db)
        held = db.blocks()
        parsed = lists.parse_tab(_lines(spark, a.file), a.repository or a.file, a.file, held, opened(a.whitelist).blocks() if a.whitelist else None)
        _show(parsed.invalid.select(F.concat(F.lit("# "), "reason", F.lit(": "), "value").alias("value")))
        report(db.insert(parsed.events, parsed.sources, parsed.names, command))
    elif a.command == "import":
        db = opened(a.db)
        parsed = lists.parse_json(_lines(spark, a.file))
        _show(parsed.invalid.select(F.concat(F.lit("# "), "reason", F.lit(": "), "value").alias("value")))
        report(db.merge(parsed.events, parsed.sources, parsed.names, command))
    elif a.command == "export":
        ends = [_binary(x) for x in a.part.split(":")] if a.part else [None, None]
        rows = lists.export_json(opened(a.db).blocks(), *ends).orderBy("kind", "key")
        out = sys.stdout if a.file == "-" else open(a.file, "w", encoding="utf-8")
        for r in rows.toLocalIterator():
            print(r["value"], file=out)
        if out is not sys.stdout:
            out.close()
    elif a.command == "add_multiple":
        *parts, dest = a.databases
        dbs = [opened(p) for p in parts]
        _into(spark, dest, dbs[0], lambda d: setops.add_multiple([x.blocks() for x in dbs], d), command)
    elif a.command in ("add", "add_repository", "subtract_repository", "add_range"):
        db = opened(a.a)
        held = db.blocks()
        build = {
            "add": lambda d: setops.add(held, d),
            "add_repository": lambda d: setops.add_repository(held, a.repository, d),
            "subtract_repository": lambda d: setops.subtract_repository(held, a.repository, d),
            "add_range": lambda d: setops.add_range(held, *_range(a.range), dest=d),
        }[a.command]
        _into(spark, a.dest, db, build, command)
    elif a.command in ("intersect", "intersect_hash", "subtract", "subtract_hash"):
        first, second = opened(a.a), opened(a.b)
        _into(spark, a.dest, first, lambda d: getattr(setops, a.command)(first.blocks(), second.blocks(), d), command)
    elif a.command == "scan_list":
        probes, comments, invalid = lists.parse_probes(_lines(spark, a.file))
        found = scan.lines(scan.scan(opened(a.db).blocks(), probes, mode))
        rows = found.unionByName(comments).unionByName(invalid.select("line", F.concat(F.lit("# invalid line: "), "value").alias("value")))
        _show(rows.orderBy("line"))
        print("# scan_list completed.")
    elif a.command == "scan_hash":
        probes = spark.createDataFrame([(0, "", bytearray(_binary(a.hash)))], "line long, label string, block_hash binary")
        found = scan.scan(opened(a.db).blocks(), probes, mode).collect()
        print(found[0]["json"] if found else f"Hash not found for '{a.hash}'")
    elif a.command == "size":
        print(scan_json(stats.sizes(opened(a.db).blocks())))
    elif a.command == "sources":
        _show(scan.source_json(opened(a.db).blocks()).orderBy("file_hash"), "json")
    elif a.command == "histogram":
        held = opened(a.db).blocks()
        total = stats.totals(held).first()
        if not total["n_distinct"]:
            print("The map is empty.")
        print(f'{{"total_hashes": {total["total_hashes"]}, "total_distinct_hashes": {total["total_distinct_hashes"]}}}')
        for r in stats.histogram(held).orderBy("duplicates").toLocalIterator():
            print(f'{{"duplicates":{r[0]}, "distinct_hashes":{r[1]}, "total":{r[2]}}}')
    elif a.command in ("duplicates", "hash_table"):
        held = opened(a.db).blocks()
        hashes = stats.duplicates(held, int(a.count)) if a.command == "duplicates" else scan.hash_table(held, _binary(a.file_hash))
        probes = hashes.select(F.col("block_hash").alias("line"), F.lit("").alias("label"), "block_hash")
        found = scan.scan(held, probes, mode).orderBy("line")
        _show(found.select(F.concat_ws("\t", codec.bin_to_hex("block_hash"), "json").alias("value")))
    elif a.command == "read_media":
        media = Media(a.path)
        sys.stdout.buffer.write(media.read_path(a.offset, int(a.count)))
        media.close()
    elif a.command == "read_media_size":
        media = Media(a.path)
        print(media.size)
        media.close()
    elif a.command in ("add_random", "add_same"):
        db = opened(a.db)
        report(db.insert(_random(spark, int(a.count), a.command == "add_same"), None, None, command))
    elif a.command in ("scan_random", "scan_same"):
        probes = _random(spark, int(a.count), a.command == "scan_same").select(F.col("seq").alias("line"), F.lit("").alias("label"), "block_hash")
        begun = time.time()
        _show(scan.lines(scan.scan(opened(a.db).blocks(), probes, mode)).orderBy("line"))
        print(f"# {a.count} hashes in {time.time() - begun:.3f} s")
    elif a.command == "test_scan_stream":
        session = ScanSession(opened(a.db).blocks(), 16, mode)
        record = bytes.fromhex(SAME) + b"\0\0"
        for _ in range(int(a.count)):
            session.put(record * 10_000)
        begun, size = time.time(), 0
        while not session.empty():
            size += len(session.get())
        print(f"# {a.count} batches, {size} bytes in {time.time() - begun:.3f} s")
    return 0


def scan_json(rows: DataFrame) -> str:
    """One row as a JSON object."""
    return rows.select(F.to_json(F.struct("*"))).first()[0]


def main() -> int:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = SparkSession.builder.appName("blockmatch").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
