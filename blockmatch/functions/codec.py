"""Hashes, counts and JSON as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockmatch.schema import LABEL_BYTES, MAX_COUNT, MAX_SUB_COUNT, PREFIX_BYTES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_bin(c: Column | str) -> Column:
    """Bytes of an even number of hexadecimal digits of either case, at least two; else null."""
    c = _col(c)
    return F.when(c.rlike("^([0-9a-fA-F]{2})+$"), F.unhex(c))


def bin_to_hex(c: Column | str) -> Column:
    return F.lower(F.hex(_col(c)))


def prefix(c: Column | str) -> Column:
    """First seven bytes, or all of a shorter hash."""
    return F.substring(_col(c), 1, PREFIX_BYTES)


def count_to_code(c: Column | str) -> Column:
    """One-byte code of a count: a mantissa of 4 bits and an exponent of 5.

    With m = count + 5, the exponent x is the least with floor(m / 5 ** x) < 20, and the mantissa is that quotient less 4.
    Codes grow with counts and leave none out, so the difference of two codes is the number of changes between.
    """
    m = _col(c).cast("long") + 5
    x = F.lit(15).cast("long")
    for e in range(14, -1, -1):
        x = F.when(m < 20 * 5**e, F.lit(e).cast("long")).otherwise(x)
    return x * 16 + F.greatest(F.floor(m / F.pow(F.lit(5.0), x)).cast("long") - 4, F.lit(0).cast("long"))


def code_to_count(c: Column | str) -> Column:
    code = _col(c).cast("long")
    return ((F.pmod(code, F.lit(16)) + 4) * F.pow(F.lit(5.0), F.floor(code / 16)).cast("long") - 5).cast("long")


def approximate_count(c: Column | str) -> Column:
    return code_to_count(count_to_code(c))


def saturated(c: Column | str, most: int = MAX_COUNT) -> Column:
    return F.least(_col(c), F.lit(most).cast("long"))


def sub_count(c: Column | str) -> Column:
    return saturated(c, MAX_SUB_COUNT)


def label(c: Column | str) -> Column:
    """At most ten bytes; a character that the cut would split goes."""
    whole = F.coalesce(_col(c), F.lit(""))
    cut = whole
    for n in range(1, LABEL_BYTES + 1):
        cut = F.when(F.octet_length(F.substring(whole, 1, n)) <= LABEL_BYTES, F.substring(whole, 1, n)).otherwise(cut if n > 1 else F.lit(""))
    return F.when(F.octet_length(whole) <= LABEL_BYTES, whole).otherwise(cut)


def source_list_id(file_hashes: Column) -> Column:
    """CRC-32 over an array of file hashes in order."""
    return F.crc32(F.unhex(F.array_join(F.transform(F.array_sort(file_hashes), lambda h: F.hex(h)), "")))


def to_uint64(c: Column | str) -> Column:
    """A leading number, else 0."""
    digits = F.regexp_extract(_col(c), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def json_string(c: Column | str) -> Column:
    """A JSON string with its quotes."""
    whole = F.to_json(F.array(F.coalesce(_col(c), F.lit(""))))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def json_object(**fields: Column) -> Column:
    """A JSON object of ready-made values, in the order given."""
    parts = [x for k, v in fields.items() for x in (F.lit(("," if k != next(iter(fields)) else "{") + f'"{k}":'), v.cast("string"))]
    return F.concat(*parts, F.lit("}"))


def json_hex(c: Column | str) -> Column:
    return F.concat(F.lit('"'), bin_to_hex(c), F.lit('"'))


def json_pairs(pairs: Column, first: str = "file_hash", second: str = "sub_count") -> Column:
    """A flat JSON array ``["<hash>", n, ...]`` of an array of structs."""
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat(json_hex(p[first]), F.lit(","), p[second].cast("string"))), ","), F.lit("]"))


def json_names(names: Column) -> Column:
    """A flat JSON array of repository and file names."""
    return F.to_json(F.flatten(F.transform(names, lambda n: F.array(n["repository_name"], n["filename"]))))
