"""Exact and near duplicates against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, words

from blockmatch.llm import exact_dedup as exact
from blockmatch.llm import near_dedup as near
from blockmatch.llm.components import components
from blockmatch.llm.minhash import circulant, scattered
from blockmatch.llm.textarrays import text_shingles

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "same text"), (5, "same text"), (5, "same text"), (None, "same text"), (6, "Same text"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "x" * 199_999 + "y"), (None, None)]


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, max(ids, default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("moduli", [exact.PRIMES, (3, 5)])
def test_exact_dedup(spark, moduli):
    """Also with primes so small that unequal texts collide, which only the comparison can tell."""
    rng = random.Random(1)
    rows = EDGE + [(100 + k, "".join(rng.choice("ab") for _ in range(3))) for k in range(60)]
    out = exact.exact_dedup(documents(spark, rows), moduli=moduli).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str) == plain_exact(rows)
    kept = [r["text_sha256"] for r in out if r["kept"]]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_exact_dedup_of_nothing(spark):
    assert exact.exact_dedup(documents(spark, [])).collect() == []


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 50_000, dtype=np.uint8)
    offsets = np.array([0, 0, 1, 4096, 8193, 50_000])
    for base, prime in zip(exact.BASES, exact.PRIMES, strict=True):
        got = exact.fingerprints(data, offsets, base, prime)
        for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            want = 0
            for x in data[lo:hi].tolist():
                want = (want * base + x) % prime
            assert int(got[k]) == want
        a, b = (int(got[2]), 4095), (int(got[3]), 4097)
        joined = exact.combine(a, b, base, prime)
        want = 0
        for x in data[1:8193].tolist():
            want = (want * base + x) % prime
        assert joined == (want, 8192)


def plain_shingles(text, n):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def plain_near(rows, n, threshold=(80, 100)):
    sets = [plain_shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and threshold[1] * common >= threshold[0] * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if sets[k] and find(m) == find(k) and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return out


def near_rows():
    """Edited copies of a few texts, from light to heavy edits, one group large."""
    rng = random.Random(2)
    rows = [(1000 + k, t) for k, (_, t) in enumerate(EDGE[:6])] + [(None, "same text"), (2000, "a b c"), (2001, "A\tB\nC"), (2002, "a b")]
    for base in range(12):
        text = words(rng, 120)
        for copy in range(150 if base == 0 else 9):
            changed = list(text)
            for _ in range(rng.randrange(8)):
                changed[rng.randrange(len(changed))] = f"new{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(changed)))
    return rows + [(rng.randrange(10**9), " ".join(words(rng, 40))) for _ in range(60)]


@pytest.mark.parametrize("n", [4, 5])
def test_near_dedup(spark, monkeypatch, n):
    monkeypatch.setattr(near, "BLOCK", 16)  # so that the large group is compared in several blocks
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 1000)
    rows = near_rows()
    # Many rows without id, many that share an id, and very long texts.
    rng = random.Random(6)
    long = words(rng, 60_000, 10**6)
    rows += [(i, t) for i, t in rows[10:40] for i in (None, 77)] + [(5, " ".join(long)), (None, " ".join(long[:-9])), (6, " ".join(long[30_000:]))]
    out = near.near_dedup(documents(spark, rows), shingle=n).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == sorted(plain_near(rows, n), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_dedup_of_nothing(spark):
    assert near.near_dedup(documents(spark, [])).collect() == []
    assert near.near_dedup(documents(spark, [(1, None), (2, "")])).count() == 2


def test_links_that_no_smallest_node_has():
    """Block comparison finds exactly the pairs at the threshold, within a block and between two."""
    sets = [np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(100, 110, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64)]
    nodes, labels = np.arange(4), np.arange(4)
    found = near.block_links(nodes, labels, np.zeros(4, int), sets, (80, 100))
    assert {frozenset(x) for x in found} == {frozenset(x) for x in ((0, 1), (1, 3))}
    assert {frozenset(x) for x in near.block_links(nodes, labels, np.array([0, 1, 0, 1]), sets, (80, 100))} == {frozenset((0, 1))}
    assert near.block_links(nodes, np.zeros(4, int), np.zeros(4, int), sets, (80, 100)) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    equal = (near.signature(a) == near.signature(b)).mean()
    assert abs(equal - 800 / 1200) < 0.15
    windows, at = circulant(4), scattered(a[:50])
    assert (windows[at].min(axis=0)[1:] == windows[np.minimum(at + 1, len(windows) - 1)].min(axis=0)[:-1]).all()


def test_shingles_of_batches_equal_those_of_single_texts():
    rng = random.Random(4)
    texts = ["", None, " ", "One", "one two three four", *(" ".join(words(rng, rng.randrange(30))) + rng.choice(["", "\n", " "]) for _ in range(200))]
    h, first = text_shingles(pa.array(texts, pa.string()), 4)
    for k, t in enumerate(texts):
        own = h[first[k] : first[k + 1]]
        assert len(set(own.tolist())) == len(plain_shingles(t, 4))
        assert (own == text_shingles(pa.array([t], pa.string()), 4)[0]).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(30)] + [(100 + k, 100) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert out == root
