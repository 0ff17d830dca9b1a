"""WARC archives: writing pages as records, and reading them back by segment reassembly.

Writing: one record for each page.  Pages of equal payload (at least
``min_bytes`` long) share one ``response`` record, that of the largest id; the
others are ``revisit`` records that refer to it.  A response's block is an HTTP
message in chunked transfer framing.  Blocks longer than ``segment`` are split:
the first part stays in the response record, the rest goes into ``continuation``
records.  Archives are gzip files in a folder that any Spark file system can
hold; Spark's text writer puts the two line ends after each record that the
format asks for, and starts a new file after a fixed number of records, so an
archive is at most that number of segments long.

Reading: every archive is streamed record by record.  Whole records are decoded
at once.  Segments go to one task by their origin's record id, sorted by segment
number, and are decoded as a stream: the chunked framing is undone, and length
and digest are counted, one segment at a time, so a payload of any size takes
little memory.  Segment numbers must run from 1 without gaps and the block
lengths must add up to the total length that the last segment names; a payload
that breaks this, or whose digest is not the declared one, has its ``problem``
named and no digest.

Defined results: a null payload counts as empty; a null URL is written without
a target; control characters and spaces in a URL are percent-encoded in the
archive; a null id is lower than any other and stays null; of repeated rows one
is the response and the others revisit it; payloads shorter than ``min_bytes``
are all responses; an empty table gives no records; only the id, URL and payload
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmatch.storage import materialise, small

SEGMENT = 32 << 10
CHUNK = 4 << 10
RECORDS = 4000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = b"\r\n\r\n"

_RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("record_id", "record_type", "page", "url", "refers_to_record", "declared", "origin")]
    + [T.StructField(c, T.LongType()) for c in ("segment", "total")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("problem", T.StringType())]
    + [T.StructField(c, T.BinaryType()) for c in ("block", "payload")]
)
_NAMES = _RECORD.fieldNames()
_KINDS = [{T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}[f.dataType] for f in _RECORD]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


class Unframe:
    """Reads an HTTP message given in any pieces; passes its payload on and counts it."""

    def __init__(self, keep: bool = False) -> None:
        self.held, self.state, self.left, self.chunked = b"", "head", 0, False
        self.sha, self.size, self.kept = hashlib.sha1(), 0, [] if keep else None

    def _out(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def feed(self, data: bytes) -> None:
        held = self.held + data if self.held else data
        at = 0
        while True:
            if self.state == "head":
                end = held.find(END, at)
                if end < 0:
                    break
                fields = held[at:end].lower().split(b"\r\n")[1:]
                self.chunked = any(f.startswith(b"transfer-encoding:") and b"chunked" in f for f in fields)
                at, self.state = end + 4, "size" if self.chunked else "rest"
            elif self.state == "size":
                end = held.find(b"\r\n", at)
                if end < 0:
                    break
                self.left = int(held[at:end].split(b";")[0], 16)
                at, self.state = end + 2, "data" if self.left else "trailer"
            elif self.state == "data":
                got = held[at : at + self.left]
                self._out(got)
                at += len(got)
                self.left -= len(got)
                if self.left:
                    break
                self.state = "end"
            elif self.state == "end":
                if len(held) < at + 2:
                    break
                if held[at : at + 2] != b"\r\n":
                    raise ValueError("chunk without line end")
                at, self.state = at + 2, "size"
            elif self.state == "trailer":
                end = held.find(b"\r\n", at)
                if end < 0:
                    break
                self.state, at = ("done" if end == at else "trailer"), end + 2
            else:
                if self.state == "rest":
                    self._out(held[at:])
                at = len(held)
                break
        self.held = held[at:]

    def close(self) -> str | None:
        """What is wrong with the message, if anything."""
        return None if self.state in ("done", "rest") else "message ends early"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    named = [("WARC-Date", DATE), *((k, v) for k, v in fields if v is not None), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block


def _urn(run: str, uid: int, part: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), f'{uid}/{part}')}>"


def page_records(run: str, uid: int, page: object, url: str | None, payload: bytes, refers: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """All records of one page, without the two line ends that close each."""
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    shared = [("WARC-Target-URI", target), ("WARC-Page-ID", None if page is None else str(page))]
    digest = ("WARC-Payload-Digest", "sha1:" + base32(hashlib.sha1(payload).digest()))
    if refers is not None:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(run, refers)), ("Content-Type", "application/http;msgtype=response")]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(run, uid)), *shared, digest, *more], HTTP)
        return
    block = HTTP + frame(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts):
        kind = [("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", _urn(run, uid))] if k else [("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response")]
        number = str(k + 1) if len(parts) > 1 else None
        total = str(len(block)) if k and k == len(parts) - 1 else None
        order = [("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)]
        yield _record([*kind, ("WARC-Record-ID", _urn(run, uid, k)), *shared, *([] if k else [digest]), *order], part)


def records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in small letters) and block of each record of an uncompressed stream."""
    while True:
        line = archive.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = archive.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or archive.read(4) != END:
            raise ValueError("record ends early")
        yield fields, block


def _verdict(decoder: Unframe, problem: str | None, declared: str | None) -> dict:
    digest = base32(decoder.sha.digest())
    problem = problem or decoder.close() or ("wrong digest" if declared and declared.removeprefix("sha1:") != digest else None)
    payload = b"".join(decoder.kept) if decoder.kept is not None and not problem else None
    return {"payload_bytes": None if problem else decoder.size, "payload_digest": None if problem else digest, "problem": problem, "payload": payload}


def _feed(decoder: Unframe, block: bytes) -> str | None:
    try:
        decoder.feed(block)
    except ValueError as e:
        return f"bad framing: {e}"
    return None


def _batches(rows: Iterator[dict], most: int = 500, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], kind) for c, kind in zip(_NAMES, _KINDS, strict=True)], _NAMES)

    for row in rows:
        held.append(row)
        size += len(row.get("block") or b"") + len(row.get("payload") or b"")
        if len(held) >= most or size > most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _parse(keep: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for content in batch.column(0):
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as plain:
                    for f, block in records(io.BufferedReader(plain, 1 << 20)):
                        kind = f.get("warc-type")
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        out = {"record_id": f["warc-record-id"], "record_type": kind, "page": f.get("warc-page-id"), "url": f.get("warc-target-uri")}
                        out |= {"refers_to_record": f.get("warc-refers-to"), "declared": f.get("warc-payload-digest")}
                        if "warc-segment-number" in f:
                            total = f.get("warc-segment-total-length")
                            out |= {"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "segment": int(f["warc-segment-number"]), "total": total and int(total), "block": block}
                        elif kind == "response":
                            decoder = Unframe(keep)
                            out |= _verdict(decoder, _feed(decoder, block), out["declared"])
                        yield out

    return lambda batches: _batches(rows(batches))


def _reassemble(keep: bool):
    """Rows of one origin come together, in the order of their segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        head, decoder, problem, seen, size, total = None, None, None, 0, 0, None

        def close() -> dict:
            wrong = problem or ("no total length" if total is None else None if total == size else f"total length {total}, found {size}")
            return head | {"record_type": "response"} | _verdict(decoder, wrong, head["declared"])

        for batch in batches:
            for row in batch.to_pylist():
                if head is None or row["origin"] != head["origin"]:
                    if head is not None:
                        yield close()
                    head, decoder, problem, seen, size, total = row | {"block": None}, Unframe(keep), None, 0, 0, None
                seen += 1
                if row["segment"] != seen:
                    problem = problem or f"segment {seen} is missing or repeated"
                size += len(row["block"])
                total = row["total"] if row["total"] is not None else total
                if not problem:
                    problem = _feed(decoder, row["block"])
        if head is not None:
            yield close()

    return lambda batches: _batches(rows(batches))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each response and revisit record below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    found = materialise(files.mapInArrow(_parse(with_payload), _RECORD), "records")
    whole = found.where(F.col("origin").isNull())
    parts = found.where(F.col("origin").isNotNull()).repartition("origin").sortWithinPartitions("origin", "segment")
    out = whole.unionByName(parts.mapInArrow(_reassemble(with_payload), _RECORD))
    columns = ["record_id", "record_type", "page", "url", "refers_to_record", "payload_bytes", "payload_digest", "problem"]
    return out.select(*columns, *(["payload"] if with_payload else []))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, segment: int = SEGMENT, records_per_file: int = RECORDS) -> None:
    """Write the pages as gzip archives into the folder ``path``."""
    own = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"))
    own = materialise(own, "pages")
    key = ["sha", "size"]
    each = own.where(F.length("payload") >= min_bytes).select("uid", "id", F.sha1("payload").alias("sha"), F.length("payload").alias("size"))
    # Largest id first, then smallest uid: two aggregations that combine before they shuffle.
    by_id = each.groupBy(*key, "id").agg(F.min("uid").alias("u"), F.count("*").alias("c"))
    order = F.struct(F.col("id").isNotNull().alias("a"), F.col("id").alias("b"))
    groups = by_id.groupBy(*key).agg(F.sum("c").alias("n"), F.max_by("u", order).alias("refers")).where("n > 1").select(*key, "refers")
    revisits = materialise(each.join(groups, key).where("uid <> refers").select(F.col("uid").alias("r_uid"), "refers"), "revisits")
    own = own.join(small(revisits, 16), F.col("uid") == F.col("r_uid"), "left")
    run = str(uuid.uuid4())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), f'info/{part}')}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                uid, page, url, payload, refers = (batch.column(c)[k].as_py() for c in range(5))
                for record in page_records(run, uid, page, url, payload, refers, segment):
                    held.append(record)
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    rows = own.select("uid", "id", "url", "payload", "refers").mapInArrow(write, "record binary")
    writer = rows.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def archive_report(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take size and digest from the response they refer to."""
    here = [F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type"]
    responses = found.where("record_type = 'response'").select("record_id", *here, "problem")
    target = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", "problem")
    revisits = found.where("record_type = 'revisit'").select("refers_to_record", here[0], "record_type").join(target, "refers_to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    return responses.withColumn("refers_to", F.lit(None).cast(id_type)).select(columns).unionByName(revisits.select(columns))
