"""Words and word shingles of Arrow text columns, as NumPy arrays.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; ASCII
capitals count as small letters.  Words get 64-bit hashes (a polynomial over a
random byte table, finished by a mixing step) and shingles combine the hashes of
consecutive words.  Everything works on whole batches of texts in pieces of
about a megabyte, so memory is bounded by the batch and not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED = 20240717
_SPAN = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_COEF = np.random.default_rng(_SEED + 1).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, _SPAN + 4096)
        for name, base in (("_pow", _BASE), ("_inv", _INVERSE)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` text bytes (a longer text stands alone)."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(batch.schema.names.index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_bounds(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 indices of each text's first word."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[b]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    s = np.flatnonzero(~space & edge[:-1])
    edge = np.ones(n + 1, bool)
    edge[:-1] = space
    edge[offsets] = True
    e = np.flatnonzero(~space & edge[1:]) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _SPAN, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        power, inverse = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[b[lo:hi]] * power[: hi - lo], out=total[1:])
        a, z = s[i:j] - lo, e[i:j] - lo
        out[i:j] = (total[z] - total[a]) * inverse[a] + (z - a).astype(np.uint64)
        i = j
    return mix(out)


def shingle_hashes(w: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles in text order and the n + 1 indices of each text's first.

    A text of fewer words gives its whole sequence as one shingle; one without words gives none.
    """
    counts = np.diff(first)
    full = len(w) - size + 1
    h = np.zeros(len(w), np.uint64)
    if full > 0:
        for k in range(size):
            h[:full] += w[k : k + full] * _COEF[k]
    last = np.repeat(first[1:], counts)
    valid = np.arange(len(w)) + size <= last
    for m in range(1, size):
        at = first[:-1][counts == m]
        h[at] = U64(m * int(_COEF[size]) % (1 << 64))
        for k in range(m):
            h[at] += w[at + k] * _COEF[k]
        valid[at] = True
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return mix(h[valid]), np.concatenate([[0], np.cumsum(made)])


def text_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    b, offsets = raw(texts)
    s, e, first = word_bounds(b, offsets)
    return shingle_hashes(word_hashes(b, s, e), first, size)
