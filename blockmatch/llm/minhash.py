"""Circulant MinHash: two permutations make any number of signature coordinates.

A shingle's hash falls into one of 2 ** 22 bins.  The first permutation scatters
the bins; the second gives them values.  Coordinate ``k`` of a set is the least
value over its bins after the second permutation is shifted circularly by ``k``,
so the values of one bin for all coordinates are neighbours in one table.
"""

from __future__ import annotations

import numpy as np

from blockmatch.llm.textarrays import U64

BITS = 22
SEED = 5
#: Coordinates that the table of values can be asked for.
MOST = 128

_tables: tuple[np.ndarray, np.ndarray] | None = None


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if _tables is None:
        rng = np.random.default_rng(SEED)
        scatter = rng.permutation(1 << BITS).astype(np.uint32)
        values = rng.permutation(1 << BITS).astype(np.uint32)
        _tables = scatter, np.concatenate([values, values[: MOST - 1]])
    return _tables


def scattered(shingles: np.ndarray) -> np.ndarray:
    """The bins of shingle hashes after the first permutation."""
    return _permutations()[0][(shingles >> U64(64 - BITS)).astype(np.int64)]


def circulant(coordinates: int) -> np.ndarray:
    """Row ``bin`` holds the bin's values for all coordinates (a view: no memory of its own)."""
    values = _permutations()[1]
    return np.lib.stride_tricks.sliding_window_view(values[: (1 << BITS) + coordinates - 1], coordinates)
