"""Blocks, features, archives inside media, images, databases, streams and the command line."""

import gzip
import hashlib
import io
import math
import struct
import zipfile
import zlib
from collections import Counter

import pytest

from blockmatch import cli
from blockmatch.functions import embedded, features
from blockmatch.operators import ingest, stats
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.database import BlockDB, Settings, Timestamps
from blockmatch.operators.merge import merge
from blockmatch.operators.scan import ScanMode
from blockmatch.sources import lists, media
from blockmatch.streaming.scan_stream import ScanSession, pack, scan_stream, unpack


FIRST, SECOND, STREAM = b"first member, a few words", b"second member, and more", b"a stream inside of it"


def image():
    """Zeros, a zip of two members and a gzip stream, in less than two blocks."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("in/one.txt"), FIRST, zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("in/two.txt"), SECOND, zipfile.ZIP_DEFLATED)
    return bytes(640) + data.getvalue() + gzip.compress(STREAM, mtime=0)


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "media" / "image.raw"
    file.parent.mkdir()
    file.write_bytes(image())
    return str(file)


def test_read_media(path):
    data, m = image(), media.Media(path)
    second, zipped = data.find(b"PK\x03\x04", 641), data.find(b"\x1f\x8b\x08")
    assert m.size == len(data)
    assert m.read_path("670", 10) == b"in/one.txt"
    for at, kind, whole in ((640, "zip", FIRST), (second, "zip", SECOND), (zipped, "gzip", STREAM)):
        assert m.read_path(f"{at}-{kind}-0", 90) == whole and m.read_path(f"{at}-{kind}-4", 7) == whole[4:11] and m.read_path(f"{at}-{kind}-400", 7) == b""
    assert m.read_path("5000", 5) == m.read_path("5000-zip-0", 5) == b""
    with pytest.raises(ValueError):
        m.read_path("640-rar-0", 5)
    assert m.hash() == hashlib.md5(data).hexdigest()
    m.close()


def test_partial_inflate_and_depth():
    whole = zlib.compress(bytes(range(256)) * 200)[2:-4]
    broken = whole[: len(whole) // 2]
    assert 0 < len(embedded.inflate(broken, 1 << 20, -15)) < 51200
    nested = b"core content of it all"
    for _ in range(9):
        nested = gzip.compress(nested, mtime=0)
    assert max(p.count("gzip") for p, _ in embedded.expand(b"x" + nested)) == 7


def test_child_blocks_and_labels():
    for content in (FIRST, SECOND, STREAM, bytes(range(200))):
        block = content.ljust(512, b"\0")
        symbols = Counter(block[k : k + 2] for k in range(0, 512, 2))
        plain = -sum(n / 256 * math.log2(n / 256) for n in symbols.values())
        assert abs(features.entropy(content, 512) - 1000 * plain) <= 1
        assert features.entropy(content, 512, twice_scaled_tail=True) == 1000 * features.entropy(content, 512)
    assert [features.label(x, 512) for x in (FIRST, SECOND, STREAM)] == ["HM"] * 3
    assert features.label(struct.pack("<128I", *range(128)), 512) == "RM"
    assert features.label(b" " * 512, 512) == "HWM"
    assert features.entropy(bytes(512), 512) == 0


def test_ingest_and_scan_media(spark, path):
    files = media.contents(spark, path)
    held = ingest.ingest(files, BlockSet.empty(spark), ingest.Options(repository="r")).materialise()
    assert tuple(stats.sizes(held).first()) == (4, 4, 4, 4, 4)
    data = image()
    second, zipped = data.find(b"PK\x03\x04", 641), data.find(b"\x1f\x8b\x08")
    assert {r["filename"].rpartition("/")[2] for r in held.source_name.collect()} == {"image.raw", "image.raw-640-zip", f"image.raw-{second}-zip", f"image.raw-{zipped}-gzip"}
    source = held.source.where("filesize > 100").first()
    assert source["zero_count"] == 1
    again = ingest.ingest(files, held, ingest.Options(repository="r"))
    assert tuple(stats.sizes(again).first()) == (4, 4, 4, 4, 4) and again.hash.agg({"count": "sum"}).first()[0] == 4
    found, zeros = ingest.scan_media(files, held, ingest.Options(), ScanMode.COUNT)
    assert sorted(r["label"] for r in found.collect())[0] == "512" and found.count() == 4 and zeros.first()[0] == 1
    alone = ingest.ingest(files, BlockSet.empty(spark), ingest.Options(recursion=False))
    assert tuple(stats.sizes(alone).first())[0] == 1


def test_ranges_cut_as_whole_files(spark, tmp_path):
    file = tmp_path / "big.raw"
    file.write_bytes(bytes(range(251)) * 100)
    parts = media.ranges(spark, str(file), window=4096, overlap=512)
    assert parts.count() == 7
    cut = ingest.ranged_blocks(parts, ingest.Options(step=300))
    data = file.read_bytes()
    want = {k: hashlib.md5(data[k : k + 512].ljust(512, b"\0")).digest() for k in range(0, len(data), 300)}
    assert {r["offset"]: bytes(r["block_hash"]) for r in cut.collect()} == want


def test_multipart_names():
    assert media.first_parts(["a.E01", "a.E02", "a.EAA", "b.E02", "c.txt"]) == ["a.E01", "b.E02", "c.txt"]


def ewf(data, chunk=1024):
    """A small image of one segment."""

    def section(kind, body, at, last=False):
        following = at if last else at + 76 + len(body)
        return kind.encode().ljust(16, b"\0") + struct.pack("<QQ", following, 76 + len(body)) + bytes(44) + body

    out = b"EVF\x09\x0d\x0a\xff\x00" + struct.pack("<BHH", 1, 1, 0)
    pieces = [data[k : k + chunk] for k in range(0, len(data), chunk)]
    out += section("volume", struct.pack("<IIIIQ", 1, len(pieces), chunk // 512, 512, len(data) // 512) + bytes(70), len(out))
    base = len(out) + 76
    stored, entries = b"", []
    for k, p in enumerate(pieces):
        packed = zlib.compress(p) if k % 2 else p + struct.pack("<I", zlib.adler32(p))
        entries.append((base + len(stored)) | (k % 2) << 31)
        stored += packed
    out += section("sectors", stored, len(out))
    out += section("table", struct.pack("<I4xQ4xI", len(entries), 0, 0) + struct.pack(f"<{len(entries)}I", *entries), len(out))
    return out + section("done", b"", len(out), last=True)


def test_expert_witness_image(tmp_path):
    data = bytes(k * 7 % 256 for k in range(512 * 9))
    file = tmp_path / "x.E01"
    file.write_bytes(ewf(data))
    m = media.Media(str(file))
    assert m.size == len(data) and m.read(0, 10_000) == data and m.read(1000, 1500) == data[1000:2500]
    m.close()


def test_images_are_ingested_through_their_format(spark, tmp_path, capsys):
    """Also by the command line; later segments of an image are no files of their own."""
    data = (b"text of a medium " * 200)[: 512 * 5] + image().ljust(1024, b"\1")
    folder = tmp_path / "case"
    folder.mkdir()
    (folder / "disk.E01").write_bytes(ewf(data))
    (folder / "disk.E02").write_bytes(ewf(data)[:13] + b"done".ljust(16, b"\0") + struct.pack("<QQ", 13, 76) + bytes(44))
    (folder / "other.raw").write_bytes(data)
    rows = {r["filename"].rpartition("/")[2]: bytes(r["content"]) for r in media.contents(spark, str(folder)).collect()}
    assert rows == {"disk.E01": data, "other.raw": data}
    db = str(tmp_path / "db")
    assert cli.run(spark, ["create", db]) == 0 and cli.run(spark, ["ingest", "-r", "r", db, str(folder)]) == 0
    assert cli.run(spark, ["scan_media", "-j", "c", db, str(folder / "disk.E01")]) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if x.partition("\t")[0] in ("0", "512", "1024", "1536", "2048")]) == 5
    held = BlockDB.open(spark, db).blocks()
    assert held.source.where(f"file_hash = X'{hashlib.md5(data).hexdigest()}' and filesize = {len(data)}").count() == 1
    assert {r["filename"].rpartition("/")[2].partition("-")[0] for r in held.source_name.collect()} == {"disk.E01", "other.raw"}


def test_pointer_survives_a_crash(spark, tmp_path):
    """A snapshot that was written without its pointer isn't seen; the pointer is never taken away."""
    db = BlockDB.create(spark, str(tmp_path / "db"))
    parsed = lists.parse_json(lists.of_lines(spark, LINES))
    db.merge(parsed.events, parsed.sources, parsed.names)
    db._write = lambda *_: (_ for _ in ()).throw(OSError("crash"))
    with pytest.raises(OSError):
        db.merge(parsed.events, parsed.sources, parsed.names)
    again = BlockDB.open(spark, db.path)
    assert again.snapshot == 1 and again.blocks().hash.count() == 2
    for _ in range(3):
        again.merge(parsed.events, parsed.sources, parsed.names)
    assert again.snapshot == 4 and sorted(p.name for p in (tmp_path / "db").iterdir() if p.name.startswith("0")) == ["00000003", "00000004"]


def test_repeated_batches_are_shown_alike(spark):
    """A micro-batch that runs again gives what it gave."""
    session = ScanSession(loaded(spark), 8)
    probes = [spark.createDataFrame([(k, "x", bytearray([b]) * 8) for k, b in enumerate(bs)], "line long, label string, block_hash binary") for bs in ((1, 2, 1), (2, 1))]
    seen = {}
    write = session.sink(lambda found, epoch: seen.setdefault(epoch, []).append(sorted(map(str, found.collect()))))
    for epoch in (0, 0, 1, 1):
        write(probes[epoch], epoch)
    assert seen[0][0] == seen[0][1] and seen[1][0] == seen[1][1]
    assert sum("source_sub_counts" in x for x in seen[0][0]) == 2 and not any("source_sub_counts" in x for x in seen[1][0])


LINES = ['{"block_hash":"0101010101010101","k_entropy":1,"source_sub_counts":["aa",1]}', '{"block_hash":"0202020202020202","source_sub_counts":["aa",2,"bb",1]}', '{"file_hash":"aa","filesize":1,"name_pairs":["r","f"]}']


def loaded(spark):
    parsed = lists.parse_json(lists.of_lines(spark, LINES))
    return merge(parsed.events, BlockSet.empty(spark), parsed.sources, parsed.names).materialise()


def test_packed_records():
    records = [(b"\1" * 8, b"label"), (b"\2" * 8, b"")]
    raw = b"".join(h + struct.pack("=H", len(x)) + x for h, x in records)
    assert unpack(raw, 8) == (records, False)
    assert unpack(raw + b"\3" * 8, 8) == (records, True) and unpack(b"", 8) == ([], False)
    assert pack([(b"\1" * 8, b"l", "{}")]) == b"\1" * 8 + struct.pack("=H", 1) + b"l" + struct.pack("=I", 2) + b"{}"


def test_session_shows_things_once(spark):
    session = ScanSession(loaded(spark), 8)
    record = lambda n: bytes([n]) * 8 + struct.pack("=H", 1) + b"x"
    session.put(record(1) + record(9) + record(1))
    session.put(b"")
    session.put(record(2) + record(1) + b"\1\2")
    assert not session.empty()
    first, second = session.get(), session.get()
    assert first.count(b"source_sub_counts") == 1 and first.count(b'"file_hash":"aa"') == 1 and first.count(b"block_hash") == 2
    assert second.count(b"source_sub_counts") == 1 and second.count(b'"file_hash":"aa"') == 0 and second.count(b'"file_hash":"bb"') == 1
    assert session.empty() and session.get() == b"" and len(session.warnings) == 1


@pytest.mark.parametrize("mode", list(ScanMode))
def test_stream(spark, tmp_path, mode):
    rows = spark.createDataFrame([(bytearray(b"\1" * 8), "a"), (bytearray(b"\1" * 8), "b"), (bytearray(b"\7" * 8), "c")], "block_hash binary, label string")
    rows.write.parquet(str(tmp_path / "in"))
    found = scan_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), loaded(spark), mode)
    query = found.writeStream.format("memory").queryName(f"stream_{mode.name}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    out = [r["json"] for r in spark.table(f"stream_{mode.name}").collect()]
    assert len(out) == 2 and sum("source_sub_counts" in x for x in out) == {ScanMode.EXPANDED: 2, ScanMode.EXPANDED_OPTIMIZED: 1}.get(mode, 0)


def test_database(spark, tmp_path):
    db = BlockDB.create(spark, str(tmp_path / "db"), Settings(block_size=1024))
    with pytest.raises(FileExistsError):
        BlockDB.create(spark, db.path)
    parsed = lists.parse_json(lists.of_lines(spark, LINES))
    assert db.merge(parsed.events, parsed.sources, parsed.names)["hash_data_merged"] == 3
    again = BlockDB.open(spark, db.path)
    assert again.settings.block_size == 1024 and again.merge(parsed.events, parsed.sources, parsed.names)["hash_data_merged_same"] == 3
    assert again.snapshot == 2 and tuple(stats.sizes(again.blocks()).first()) == (4, 2, 2, 2, 1)
    assert again.first_hash() == b"\1" * 8 and again.next_hash(b"\1" * 8) == b"\2" * 8 and again.next_hash(b"\2" * 8) is None
    assert again.first_source() == b"\xaa" and again.next_source(b"\xaa") == b"\xbb"
    with pytest.raises(KeyError):
        again.next_hash(b"\5")
    with pytest.raises(ValueError):
        Settings.parse('{"settings_version":3, "block_size":512}')
    assert '"name":"x"' in Timestamps().stamp("x") and Settings().text() == '{"settings_version":4, "block_size":512}'


def test_command_line(spark, tmp_path, capsys, path):
    db, other, out = (str(tmp_path / n) for n in ("one", "two", "out.json"))
    text = tmp_path / "in.json"
    text.write_text("\n".join(LINES))
    probes = tmp_path / "list.txt"
    probes.write_text("# note\nfp\t0101010101010101\nfp\t0707070707070707\n")

    def said(*argv):
        assert cli.run(spark, list(argv)) == 0
        return capsys.readouterr().out

    said("create", db)
    assert "hash_data_merged: 3" in said("import", db, str(text))
    said("export", db, out)
    assert len(open(out).read().splitlines()) == 4
    assert said("scan_list", "-j", "c", db, str(probes)).splitlines() == ["# note", 'fp\t0101010101010101\t{"block_hash":"0101010101010101","count":1}', "# scan_list completed."]
    assert said("scan_hash", db, "09").startswith("Hash not found")
    assert '"total_hashes": 4' in said("histogram", db)
    said("add_range", db, other, "2:")
    assert '"hash_data_store":3' in said("size", other)
    assert said("duplicates", "-j", "c", db, "3").startswith("0202020202020202\t")
    assert len(said("hash_table", db, "aa").splitlines()) == 2
    assert said("read_media_size", path).strip() == str(len(image()))
    assert "hash_data_inserted: 70" in said("add_same", other, "70")
    assert "hash_data_inserted: 4" in said("ingest", "-r", "r", db, path)
    assert len(said("scan_media", "-j", "c", db, path).splitlines()) == 5
