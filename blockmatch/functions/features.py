"""Entropy and content labels of blocks.

A block shorter than the block size counts as if zeros followed.  The functions
work on a matrix with a padded block in each row; ``block_features`` applies
them to a column in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


#: Bytes of blocks that are looked at together.
_SLICE = 4 << 20


def padded(block: bytes, size: int) -> np.ndarray:
    return np.frombuffer(block[:size].ljust(size, b"\0"), np.uint8)


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """The rows as words of ``kind``, without the bytes that are left over."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data[:, : data.shape[1] // width * width]).view(kind)


def entropies(data: np.ndarray) -> np.ndarray:
    """Shannon entropy of each row's 16-bit little-endian symbols, in thousandths.

    Sums are taken in single precision, in the order of the symbols.
    """
    symbols = np.sort(_words(data, "<u2"), axis=1)
    rows, n = symbols.shape
    if not n or not rows:
        return np.zeros(rows, np.int64)
    # The last place of each run of equal symbols, over all rows end to end.
    last = np.ones((rows, n), bool)
    last[:, :-1] = symbols[:, 1:] != symbols[:, :-1]
    ends = np.flatnonzero(last)
    p = (np.diff(ends, prepend=-1) / n).astype(np.float32)
    terms = np.zeros(rows * n, np.float32)
    terms[ends] = (-p * np.log2(p.astype(np.float64)).astype(np.float32)).astype(np.float32)
    totals = np.cumsum(terms.reshape(rows, n), axis=1, dtype=np.float32)[:, -1]
    return np.floor(totals.astype(np.float64) * 1000 + 0.5).astype(np.int64)


def entropy(block: bytes, size: int, twice_scaled_tail: bool = False) -> int:
    """``entropies`` of one block.

    ``twice_scaled_tail`` gives short blocks the older figure, rounded and multiplied by a thousand once more.
    """
    value = int(entropies(padded(block, size)[None, :])[0])
    return value * 1000 if twice_scaled_tail and len(block) < size else value


def is_ramp(data: np.ndarray) -> np.ndarray:
    """Most 32-bit little-endian words are one less than the next."""
    size = data.shape[1]
    words, pairs = _words(data, "<u4"), (size - 9) // 4 + 1 if size > 8 else 0
    return (words[:, :pairs] + np.uint32(1) == words[:, 1 : pairs + 1]).sum(axis=1) > size // 8 if pairs else np.zeros(len(data), bool)


def is_histogram(data: np.ndarray) -> np.ndarray:
    """Fewer than three distinct big-endian words, or one of them very frequent; the last word isn't looked at."""
    size = data.shape[1]
    n, most = (size - 5) // 4 + 1 if size > 4 else 0, size // 16
    words = np.sort(_words(data[:, : n * 4], ">u4"), axis=1)
    kinds = (words[:, 1:] != words[:, :-1]).sum(axis=1) + (n > 0)
    # In order, a word is more frequent than ``most`` where it stands again that many places on.
    return (kinds < 3) | (words[:, most:] == words[:, : max(n - most, 0)]).any(axis=1)


def is_whitespace(data: np.ndarray) -> np.ndarray:
    return _WHITE[data].sum(axis=1) * 4 >= data.shape[1] * 3


def is_monotonic(data: np.ndarray) -> np.ndarray:
    """Three quarters of the words increase, decrease or stay towards the next; the last pair isn't looked at."""
    size = data.shape[1]
    words, pairs = _words(data, "<u4"), (size - 9) // 4 + 1 if size > 8 else 0
    a, b, least = words[:, :pairs], words[:, 1 : pairs + 1], size / 4 * 0.75
    return ((b > a).sum(axis=1) >= least) | ((b < a).sum(axis=1) >= least) | ((b == a).sum(axis=1) >= least)


def labels(data: np.ndarray) -> np.ndarray:
    """Letters of the labels that apply to each row, always in the order ``RHWM``."""
    out = np.full(len(data), "", object)
    for name, test in (("R", is_ramp), ("H", is_histogram), ("W", is_whitespace), ("M", is_monotonic)):
        out[test(data)] += name
    return out


def label(block: bytes, size: int) -> str:
    return labels(padded(block, size)[None, :])[0]


def block_features(block: Column | str, size: int, with_entropy: bool = True, with_labels: bool = True) -> Column:
    """(k_entropy, block_label) of a binary column."""
    if not with_entropy and not with_labels:
        return F.struct(F.lit(0).cast("long").alias("k_entropy"), F.lit("").alias("block_label"))
    step = max(_SLICE // max(size, 1), 1)

    @F.pandas_udf("k_entropy long, block_label string")
    def run(blocks: pd.Series) -> pd.DataFrame:
        numbers, names = np.zeros(len(blocks), np.int64), np.full(len(blocks), "", object)
        for at in range(0, len(blocks), step):
            part = [bytes(b or b"")[:size].ljust(size, b"\0") for b in blocks.iloc[at : at + step]]
            data = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), size)
            if with_entropy:
                numbers[at : at + step] = entropies(data)
            if with_labels:
                names[at : at + step] = labels(data)
        return pd.DataFrame({"k_entropy": numbers, "block_label": names})

    return run(block)
