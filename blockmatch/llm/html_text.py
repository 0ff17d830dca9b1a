"""Main text of HTML pages, by wrappers inferred for each host.

1. Every page becomes a token stream and its own folded expression.
2. Distinct expressions of a host, found by an aggregation that combines before
   it shuffles, are aligned to one wrapper: first in parts of about ``PART``
   expressions, then ``FAN`` results at a time, level by level.  Pages only count
   through their distinct expressions, so a host with a third of all pages costs
   no more than its variety, and no task holds more than a part of that.
3. Each page is matched to its host's wrapper, which gives every text a slot.
   A slot that shows the same text on at least ``CONSTANT`` pages of the host
   that differ in the texts of its label is part of the host's template; copies
   of a page count once.  All other slots outside of menus, headers and the like
   vary or repeat, and are text.  Landmarks only say where to begin: an article,
   else another content landmark, else the rest; a further region is added if it
   has more than ``OUTER`` times the text found so far, so that a teaser in an
   article does not stand for the story around it.  Template slots inside a
   landmark stay if they are more than half of its text on the page: such pages
   are near copies of each other, and not text within a frame.

Blocks are joined by line ends; white space inside them is one space, character
references are decoded.

Defined results: a null or empty page has the empty text; a null URL, or one
without a host, belongs to the host ``""``; repeated pages are pages like any
other; a null id is kept; an empty table gives an empty result; only the id,
URL and page columns are read, so others may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from blockmatch.llm.pagetokens import tokens
from blockmatch.llm.textarrays import pieces
from blockmatch.llm.wrappers import Wrapper, align, dumps, fold
from blockmatch.storage import materialise, small

PART = 1000
FAN = 32
CONSTANT = 3
OUTER = 2

_SLOTS = pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string()), ("page", pa.int64()), ("hash", pa.int64()), ("text", pa.string())]))

_ready: dict[str, Wrapper] = {}


def expression(html: str | None) -> str:
    return dumps(fold([symbol for symbol, _ in tokens(html)]))


def _wrapper(text: str) -> Wrapper:
    if text not in _ready:
        if len(_ready) > 2000:
            _ready.clear()
        _ready[text] = Wrapper(json.loads(text))
    return _ready[text]


def slots(html: str | None, wrapper: str) -> list[tuple[int, str, str]]:
    """(place, label, text) of each text of a page, in page order."""
    stream = tokens(html)
    symbols = [s for s, _ in stream]
    places = _wrapper(wrapper).match(symbols)
    if places is None:  # not a page the wrapper was made from: its own expression fits
        places = [-1] * len(symbols)
    return [(p, s[1:], text) for p, (s, text) in zip(places, stream, strict=True) if text]


def main_text(found: list[tuple[int, str, str]], template: frozenset[int] = frozenset()) -> str:
    use, length = set(), 0
    for region in "acu":
        own = [(place, len(text)) for place, label, text in found if label == region]
        varying = sum(n for place, n in own if place not in template)
        if region != "u" and 2 * varying < (whole := sum(n for _, n in own)):
            template -= {place for place, _ in own}
            varying = whole
        if varying > OUTER * length:
            use.add(region)
            length += varying
    return "\n".join(text for place, label, text in found if label in use and place not in template)


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "html"):
            out = [(host, expression(html)) for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["host", "expression"])


def merge(expressions: list[str]) -> str:
    """The wrapper of all, always in the same order."""
    out: list | None = None
    for text in sorted(set(expressions), key=lambda s: (len(s), s)):
        parts = json.loads(text)
        out = parts if out is None else align(out, parts)
    return dumps(out or [])


def _merge_table(table: pa.Table) -> pa.Table:
    return pa.table({"host": table["host"][:1], "expression": pa.array([merge(table["expression"].to_pylist())], pa.string()), "part": table["part"][:1]})


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of each page; a slot's page is the hash of all texts of its label on the page."""
    for batch in batches:
        for part in pieces(batch, "html"):
            out = []
            for html, wrapper in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                found = [x for x in slots(html, wrapper) if x[1] != "b"]
                page = {region: _hash("\n".join(text for _, label, text in found if label == region)) for region in {label for _, label, _ in found}}
                out.append([{"place": place, "label": label, "page": page[label], "hash": _hash(text), "text": text} for place, label, text in found])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, _SLOTS)], ["id", "url", "host", "slots"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        text = [main_text([(x["place"], x["label"], x["text"]) for x in found], frozenset(template or ())) for found, template in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["id", "url", "text"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) for pages (host, html)."""
    text = "host string, expression string"
    kinds = materialise(pages.select("host", "html").mapInArrow(_expressions, text).groupBy("host", "expression").count().drop("count"), "expressions")
    parts = kinds.groupBy("host").agg(F.ceil(F.count("*") / PART).alias("parts"))
    most = parts.agg(F.coalesce(F.max("parts"), F.lit(0))).first()[0]
    found = kinds.join(parts, "host").select("host", "expression", F.pmod(F.xxhash64("expression"), "parts").alias("part"))
    while True:
        found = found.groupBy("host", "part").applyInArrow(_merge_table, text + ", part long")
        if most <= 1:
            return materialise(found.select("host", F.col("expression").alias("wrapper")), "wrappers")
        most = -(-most // FAN)
        found = found.withColumn("part", F.expr(f"part div {FAN}"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text), one row for each page."""
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)
    pages = pages.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    wrappers = infer_wrappers(pages)
    matched = pages.join(small(wrappers, F.length("wrapper") + F.length("host")), "host").select("id", "url", "host", "html", "wrapper")
    kinds = T.StructType([*pages.schema.fields[:2], T.StructField("host", T.StringType()), T.StructField("slots", from_arrow_type(_SLOTS))])
    found = materialise(matched.mapInArrow(_found, kinds), "slots")
    shown = found.select("host", F.explode("slots").alias("s")).where("s.place >= 0").select("host", "s.place", "s.page", "s.hash")
    once = shown.groupBy("host", "place", "page").agg(F.min("hash").alias("x"), F.max("hash").alias("y"))
    constant = once.groupBy("host", "place").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.count("*").alias("n")).where(f"x = y and n >= {CONSTANT}")
    template = materialise(constant.groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("template")), "templates")
    rows = found.join(small(template, F.size("template") * 8 + F.length("host")), "host", "left").select("id", "url", "slots", "template")
    out = rows.mapInArrow(_extract, T.StructType([*pages.schema.fields[:2], T.StructField("text", T.StringType())]))
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
