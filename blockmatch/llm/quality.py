"""Text quality by weak labels: heuristics, expectation-maximisation, a hashed linear scorer.

``LABELLERS`` are heuristics that overlap; each votes good (1), poor (0) or
abstains (-1) on a text.  How often each pattern of votes occurs is counted over
the whole corpus, an aggregation whose result is bounded by the number of
patterns and not by the corpus.  From the counts, expectation-maximisation
estimates the shares of good texts and of the families of faults, and for each
labeller the chance of each vote on each of them, hence its accuracy; the
patterns' posteriors follow.  No gold label is used.

The scorer is a logistic regression on hashed features of the text itself: the
shapes of its words (letters, capitals, digits and signs with runs folded), of
word pairs, and how much repeats.  It is trained on the posteriors of the
``SAMPLE`` texts with the smallest hash of their id, of one row each and as many
as have ``FEATURES`` features together, and gives every whole text a score.

Defined results: a null or empty text, or one without words, makes all labellers
abstain, and scores the model's offset with the features of an empty text;
without any text every score is 0.5; repeated rows score alike; null ids are
scored like others; an empty table gives an empty result; only the id and text
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from blockmatch.llm.textarrays import U64, pieces, raw, shingle_hashes, word_bounds, word_hashes
from blockmatch.storage import materialise

BUCKETS = 1 << 16
SAMPLE = 6000
FEATURES = 3_000_000
KEEP_FROM = 0.5
#: Word runs whose repetition is measured.
RUN = 8

_LETTER, _CAPITAL, _DIGIT, _MARK, _BANG, _SIGN, _SPACE = range(7)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[0x80:] = _LETTER
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _c in ".,;:?'\"()-":
    _CLASS[ord(_c)] = _MARK
_CLASS[ord("!")] = _BANG
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
#: Letters and digits of a kind are one; signs stay themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_CLASS == _LETTER] = ord("a")
_SHAPE[_CLASS == _CAPITAL] = ord("\x01")
_SHAPE[_CLASS == _DIGIT] = ord("0")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    for k, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if hi > lo:
            s = np.sort(h[lo:hi])
            out[k] = 1 + (s[1:] != s[:-1]).sum()
    return out


class Measures:
    """Figures of a batch of texts, one array each."""

    def __init__(self, texts: pa.Array) -> None:
        b, offsets = raw(texts)
        s, e, first = word_bounds(b, offsets)
        kind = _CLASS[b]
        words = np.diff(first)
        chars = np.maximum(_sums((kind != _SPACE) & ((b & 0xC0) != 0x80), offsets), 1)
        letters = _sums(((kind == _LETTER) & ((b & 0xC0) != 0x80)) | (kind == _CAPITAL), offsets)
        self.words = words
        n = np.maximum(words, 1)
        self.signs = _sums(kind == _SIGN, offsets) / chars
        self.capitals = _sums(kind == _CAPITAL, offsets) / np.maximum(letters, 1)
        self.bangs = _sums(kind == _BANG, offsets) / n
        self.letters = letters / chars
        self.length = chars / n
        last = kind[e - 1] if len(e) else np.zeros(0, np.uint8)
        self.ends = _sums(last <= _MARK, first) / n
        hashes = word_hashes(b, s, e)
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[first[:-1][words > 0]] = False
        self.stutter = _sums(again, first) / n
        h, starts = shingle_hashes(hashes, first, RUN)
        runs = np.diff(starts)
        self.repeated = np.where(words >= RUN, 1 - _distinct_counts(h, starts) / np.maximum(runs, 1), 0.0)
        # Shapes: classes with runs inside a word folded.
        shape = _SHAPE[b]
        keep = np.ones(len(b), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[s] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        self.shapes = word_hashes(shape[keep], at[s], at[e])
        self.first = first

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and values of all texts on end, and the n + 1 indices of each text's first."""
        n, words, first = len(self.words), self.words, self.first
        owner = np.repeat(np.arange(n), words)
        each = 1 / np.maximum(words, 1)[owner]
        pair = self.shapes.copy()
        pair[:-1] += self.shapes[1:] * U64(0x9E3779B97F4A7C15)
        inner = np.ones(len(pair), bool)
        inner[first[1:][words > 0] - 1] = False
        bins = np.stack([np.minimum(x * 10, 9).astype(np.int64) for x in (self.repeated, self.stutter, 1 - self.ends)] + [np.minimum(np.log2(words + 1), 19).astype(np.int64)])
        extra = (np.arange(4)[:, None] * 32 + bins).T
        size = words + (words - (words > 0)) + 4
        start = np.concatenate([[0], np.cumsum(size)])
        bucket, value = np.empty(start[-1], np.int64), np.empty(start[-1])
        place = np.arange(len(owner)) - first[:-1][owner]
        at = start[:-1][owner] + place
        bucket[at], value[at] = (self.shapes % U64(BUCKETS - 128)).astype(np.int64) + 128, each
        at = (start[:-1][owner] + words[owner] + place)[inner]
        bucket[at], value[at] = ((pair[inner] >> U64(20)) % U64(BUCKETS - 128)).astype(np.int64) + 128, each[inner]
        for k in range(4):
            at = start[1:] - 4 + k
            bucket[at], value[at] = extra[:, k], 0.5
        return bucket, value, start


def _votes(poor: np.ndarray, good: np.ndarray, m: Measures, least: int) -> np.ndarray:
    return np.where(m.words < least, -1, np.where(poor, 0, np.where(good, 1, -1))).astype(np.int8)


#: Name, family of faults (1 characters, 2 shouting, 3 repetition) and vote of each heuristic; between its two bounds, and on texts too short for it, it abstains.
LABELLERS = (
    ("signs", 1, lambda m: _votes(m.signs > 0.10, m.signs < 0.03, m, 2)),
    ("capitals", 2, lambda m: _votes(m.capitals > 0.5, m.capitals < 0.25, m, 3)),
    ("bangs", 2, lambda m: _votes(m.bangs > 0.5, m.bangs < 0.1, m, 3)),
    ("letters", 1, lambda m: _votes(m.letters < 0.7, m.letters > 0.85, m, 2)),
    ("word_ends", 1, lambda m: _votes(m.ends < 0.6, m.ends > 0.9, m, 3)),
    ("stutter", 3, lambda m: _votes(m.stutter > 0.3, m.stutter < 0.1, m, 8)),
    ("repeated_runs", 3, lambda m: _votes(m.repeated > 0.45, m.repeated < 0.25, m, 2 * RUN)),
    ("word_length", 1, lambda m: _votes((m.length > 20) | (m.length < 1.5), (m.length > 2.5) & (m.length < 14), m, 3)),
)


def vote(texts: pa.Array) -> np.ndarray:
    """(texts, labellers) votes."""
    m = Measures(texts)
    return np.stack([f(m) for _, _, f in LABELLERS], axis=1) if len(texts) else np.zeros((0, len(LABELLERS)), np.int8)


def pattern(votes: np.ndarray) -> np.ndarray:
    """One number for each row of votes."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1]))


class LabelModel:
    """Shares of good texts and of each family of faults, and the chance of each vote of each labeller on each of these classes.

    Poor texts are of several kinds, and a heuristic for one kind finds nothing wrong with another.  So the
    latent class is good or one of the families; a text's quality is the chance that it is good.
    """

    def __init__(self, counts: dict[int, int], families: list[int] | None = None, rounds: int = 100) -> None:
        families = [f for _, f, _ in LABELLERS] if families is None else families
        labellers, kinds = len(families), 1 + max(families)
        keys = np.array(sorted(counts), np.int64)
        weight = np.array([counts[int(k)] for k in keys], float)
        votes = (keys[:, None] // 3 ** np.arange(labellers)) % 3
        one = np.eye(3)[votes]  # pattern, labeller, vote
        # Start: a text is as poor, in each family, as poor votes from it; a poor vote weighs as much as half of all good ones, as heuristics find faults.
        faults = np.stack([(votes[:, [f == k for f in families]] == 1).sum(axis=1) for k in range(1, kinds)]).astype(float)
        start = np.vstack([(votes == 2).sum(axis=1)[None] / max(labellers / 2, 1) + 0.1, faults + 0.01])
        belief = start / start.sum(axis=0)
        self.share, self.chance = np.full(kinds, 1 / kinds), np.full((kinds, labellers, 3), 1 / 3)
        for _ in range(rounds if len(keys) else 0):
            both = belief * weight
            total = both.sum(axis=1)
            self.share = (total + 1) / (total.sum() + kinds)
            self.chance = (np.einsum("cp,plv->clv", both, one) + 0.1) / (total[:, None, None] + 0.3)
            fresh = self._beliefs(one)
            change, belief = np.abs(fresh - belief).max(), fresh
            if change < 1e-9:
                break
        self.posteriors = dict(zip(keys.tolist(), self._beliefs(one)[0].tolist(), strict=True)) if len(keys) else {}

    def _beliefs(self, one: np.ndarray) -> np.ndarray:
        # Abstaining tells of a text's length and not of its quality.
        given = self.chance[:, :, 1:] / self.chance[:, :, 1:].sum(axis=2, keepdims=True)
        z = np.einsum("plv,clv->cp", one[:, :, 1:], np.log(given)) + np.log(self.share)[:, None]
        z = np.exp(z - z.max(axis=0))
        return z / z.sum(axis=0)

    def accuracies(self) -> dict[str, float]:
        """Each labeller's chance to be right where it votes."""
        right = self.share[0] * self.chance[0, :, 2] + np.einsum("c,cl->l", self.share[1:], self.chance[1:, :, 1])
        votes = np.einsum("c,cl->l", self.share, self.chance[:, :, 1:].sum(axis=2))
        return dict(zip((n for n, _, _ in LABELLERS), (right / np.maximum(votes, 1e-12)).tolist(), strict=False))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 400, rate: float = 0.05, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on (buckets, values, target) rows."""
    weights, offset = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, offset
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    column, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    importance = np.where(y < 0.5, 0.5 / max((y < 0.5).sum(), 1), 0.5 / max((y >= 0.5).sum(), 1))
    mean, square, mean_o, square_o = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weights[column] * value, len(y)) + offset
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient, gradient_o = np.bincount(column, error[owner] * value, BUCKETS) + l2 * weights, error.sum()
        # Adam.
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        mean_o, square_o = 0.9 * mean_o + 0.1 * gradient_o, 0.99 * square_o + 0.01 * gradient_o**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        weights -= rate * (mean / a) / (np.sqrt(square / b) + 1e-8)
        offset -= rate * (mean_o / a) / (np.sqrt(square_o / b) + 1e-8)
    return weights, float(offset)


def _merged(bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One value for each bucket of a text."""
    kinds, where = np.unique(bucket, return_inverse=True)
    return kinds, np.bincount(where, value, len(kinds))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, LabelModel]:
    """((id, score, pattern, posterior), the label model): scores 0 to 1, higher for better texts."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(pattern(vote(part.column(0))))], ["pattern"])

    counted = docs.select("text").mapInArrow(voting, "pattern long").groupBy("pattern").count()
    counts = {r["pattern"]: r["count"] for r in counted.collect()}  # at most 3 ** labellers rows
    model = LabelModel(counts)

    def describing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                votes = pattern(vote(part.column(1))).tolist()
                bucket, value, start = Measures(part.column(1)).features()
                rows = [_merged(bucket[lo:hi], value[lo:hi]) for lo, hi in zip(start[:-1], start[1:], strict=True)]
                columns = [part.column(0), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([model.posteriors[v] for v in votes], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["order", "n", "buckets", "values", "target"])

    # The smallest hashes: ids first, then the texts of these few, one for each id; what is beyond the bound on features stays in the table.
    ids = F.broadcast(docs.select("id").where(F.col("id").isNotNull()).distinct().select("id", F.xxhash64("id").alias("order")).orderBy("order", "id").limit(sample))
    described = docs.join(ids, "id").select("order", "text").mapInArrow(describing, "order long, n long, buckets binary, values binary, target double")
    described = materialise(described.groupBy("order").agg(F.min(F.struct("n", "buckets", "values", "target")).alias("x")).select("order", "x.*"), "quality-sample")
    use = described.select("order", F.sum("n").over(Window.orderBy("order")).alias("total")).where(F.col("total") <= FEATURES)
    chosen = described.join(F.broadcast(use.select("order")), "order", "left_semi").orderBy("order").toArrow()
    rows = [(np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float64), t.as_py()) for x, v, t in zip(*(chosen[c] for c in ("buckets", "values", "target")), strict=True)]
    weights, offset = fit_scorer(rows)

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                m = Measures(part.column(1))
                votes = pattern(np.stack([f(m) for _, _, f in LABELLERS], axis=1))
                bucket, value, start = m.features()
                z = _sums(weights[bucket] * value, start) + offset
                scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                posterior = [model.posteriors.get(v, 0.5) for v in votes.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(votes), pa.array(posterior, pa.float64())], ["id", "score", "pattern", "posterior"])

    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("pattern", T.LongType()), T.StructField("posterior", T.DoubleType())])
    return docs.mapInArrow(scoring, kind).withColumnRenamed("id", id_col), model
