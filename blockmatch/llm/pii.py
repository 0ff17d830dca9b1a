"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over each text once and finds anchors: ``@``,
``+``, ``://``, digits, and cues that name an identifier (``IBAN``, ``SSN``,
``account no`` ...).  Each anchor is expanded by a local parser that reads only
its surroundings and validates what it finds:

* ``email``: left from the ``@`` over the characters of a local part, but not
  into the address before it, right over a dotted domain;
* ``ip`` and ``card``: inside the run of digits, dots, spaces and hyphens that
  starts at a digit not yet covered: four numbers of at most 255, and 14 to 19
  digits that pass Luhn's test;
* ``phone``: from a ``+``, 10 to 15 digits;
* ``account``: after a cue, an IBAN with valid check digits, a social security
  number of a valid range, or an account number of 8 to 17 digits;
* ``address``: around ``://``, a URL that holds a user's name and password.

The first four give, for every text, just what their regular expressions find
from left to right without overlaps (``brute_force`` states them); what fails its
test is dropped and not tried again in part.  Positions are code points, ends
are exclusive.

Defined results: a null or empty text has no spans; null ids and repeated rows
are rows like any other; an empty table gives an empty result; only the id and
text columns are read, so others may have any name.  Memory is bounded by a
batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmatch.llm.textarrays import pieces

#: In the order in which spans of equal start are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address")

_CUES = {
    "iban": ("IBAN", "iban", "Iban"),
    "ssn": ("SSN", "ssn", "Social Security", "social security", "SOCIAL SECURITY"),
    "number": ("Account", "account", "ACCOUNT", "Acct", "acct", "Kontonummer", "kontonummer", "Konto-Nr", "numéro de compte", "número de cuenta"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9][0-9.\x20-]*[0-9]")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\x20A-Za-z]{0,12}[\x20:=#]{0,3}([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NUMBER = re.compile(r"(?:\x20?(?:no|No|NO|nr|Nr|number|Number|num)\.?)?[\x20:=#]{1,3}([0-9]{8,17})(?![0-9A-Za-z])")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_NOT_DIGIT = re.compile(r"[^0-9]")

_found = None


def automaton():
    """One for each worker."""
    global _found
    if _found is None:
        import ahocorasick

        _found = ahocorasick.Automaton()
        for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in "0123456789"), *((w, k) for k, words in _CUES.items() for w in words)):
            _found.add_word(word, kind)
        _found.make_automaton()
    return _found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def valid_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", text)) <= 15


def valid_iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind, of all personal data in a text."""
    if not text:
        return []
    spans, email_end, run_end = [], 0, 0
    for end, kind in automaton().iter(text):
        if kind == "digit":
            if end < run_end:
                continue
            run = _RUN.match(text, end)
            run_end = run.end() if run else end + 1
            if run:
                spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text, end, run_end) if valid_ip(m[0])]
                spans += [("card", m.start(), m.end()) for m in _CARD.finditer(text, end, run_end) if valid_card(m[0])]
        elif kind == "at":
            start = end
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif kind == "plus":
            if (m := _PHONE.match(text, end)) and valid_phone(m[0]):
                spans.append(("phone", m.start(), m.end()))
        elif kind == "scheme":
            start = end - 2
            while start > 0 and text[start - 1] in _SCHEME and end - start < 16:
                start -= 1
            while start < end - 2 and not text[start].isalpha():
                start += 1
            if start < end - 2 and (m := _LOGIN.match(text, end + 1)):
                spans.append(("address", start, m.end()))
        elif kind == "iban":
            if m := _IBAN.match(text, end + 1):
                # The longest whole number of groups that passes the check.
                for stop in range(m.end(1), m.start(1) + 14, -1):
                    if text[stop - 1] != " " and (stop == m.end(1) or not text[stop].isalnum()) and valid_iban(text[m.start(1) : stop]):
                        spans.append(("account", m.start(1), stop))
                        break
        elif kind == "ssn":
            if (m := _SSN.match(text, end + 1)) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                spans.append(("account", m.start(1), m.end(3)))
        elif m := _NUMBER.match(text, end + 1):
            spans.append(("account", m.start(1), m.end(1)))
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The spans of the base kinds, by their regular expressions over the whole text."""
    kinds = (("email", _EMAIL, lambda _: True), ("ip", _IP, valid_ip), ("card", _CARD, valid_card), ("phone", _PHONE, valid_phone))
    spans = [(kind, m.start(), m.end()) for kind, pattern, valid in kinds for m in pattern.finditer(text or "") if valid(m[0])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the personal data of each text as an array of (kind, start, end)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [[{"kind": k, "start": a, "end": z} for k, a, z in find_spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, span)], ["id", "spans"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return docs.mapInArrow(run, T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("spans", kind)])).withColumnRenamed("id", id_col)
