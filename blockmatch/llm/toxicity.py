"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hash buckets of the character n-grams of its words
(small letters, with word edges), each present or absent, computed for many texts
at once.  From a bounded sample of labelled texts every bucket gets the log ratio
of its rates in both classes, shrunk towards zero by its standard error: the rates
of rare n-grams differ by chance.  A logistic regression is trained on the presences scaled by
these ratios and by the root of the number of present buckets.  Ratio and weight
are multiplied, so scoring adds up one number for each present bucket.

The sample: of the labelled rows that may be learned from, the ``POSITIVES`` and
``NEGATIVES`` with the smallest hash of their id, and of their texts as many as
have ``FEATURES`` features together; of rows that share an id one is taken, the
one of fewest features.  The bound is applied before anything reaches the
driver; the model, one float for each bucket, goes to the executors with the
function.

Defined results: a null text counts as empty and scores the model's offset, as
any text without words; labels other than 0 and 1, and ids labelled both, are
not learned from; ids may be of any type that can be compared; without examples
of both classes every score is the share of positives (0 without any); repeated
rows score alike; null ids are scored, never learned from; an empty table gives
an empty result; all columns of the documents pass through but one that has the
name asked for the scores, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from blockmatch.llm import caches
from blockmatch.llm.textarrays import pieces
from blockmatch.storage import lean, materialise

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
POSITIVES = 1500
NEGATIVES = 3500
FEATURES = 12_000_000
LEAST_DOCS = 4
#: Standard errors by which a bucket's log ratio is shrunk; chosen with the step size by cross-validation inside rows that may be learned from.
ERRORS = 1.5
THRESHOLD = 0.3

_LONGEST = max(SIZES)
_COEF = np.random.default_rng(20240731).integers(1, 1 << 31, _LONGEST + 1, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_IS_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
#: Bytes of texts that are hashed together, and letters of a longer text at a time: the arrays of one step take some 50 bytes for each.
_STEP = 1 << 18
_mark = np.zeros(BUCKETS, np.int32)


def _buckets(letters: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, the places and buckets of all n-grams without white space between their first and last letter."""
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _IS_SPACE[np.minimum(codes, 0x3001)]
    codes = np.where(space, np.uint32(0x20), codes)
    before = np.concatenate([np.zeros(1, np.int32), np.cumsum(space, dtype=np.int32)])
    h, out = np.zeros(len(codes), np.uint32), []
    for n in range(1, min(_LONGEST, len(codes)) + 1):
        h = h[: len(codes) - n + 1] + (codes[n - 1 :] + np.uint32(1)) * _COEF[n]
        if n in SIZES:
            at = np.flatnonzero(before[n - 1 : len(codes)] == before[1 : len(codes) - n + 2])
            x = (h[at] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            out.append((at, ((x ^ (x >> np.uint32(16))) & np.uint32(BUCKETS - 1)).astype(np.int32)))
    return out


def _distinct(found: np.ndarray) -> np.ndarray:
    order = np.arange(len(found), dtype=np.int32)
    _mark[found] = order
    return found[_mark[found] == order]


def _long(text: str) -> np.ndarray:
    found = np.zeros(0, np.int32)
    for lo in range(0, len(text), _STEP):
        end = lo + _STEP + _LONGEST - 1
        part = (" " if not lo else "") + text[lo:end] + (" " if end >= len(text) else "")
        found = _distinct(np.concatenate([found, *(b for _, b in _buckets(part))]))
    return found


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct buckets of each text; a long text goes through in steps."""
    small = [(t or "").lower() for t in texts]
    if sum(map(len, small)) > _STEP:
        return [_long(t) if len(t) > _STEP else features([t])[0] for t in small]
    edges = np.cumsum([0, *(len(t) + 1 for t in small)])
    found = _buckets(" " + " ".join(small) + " ")
    cuts = [np.searchsorted(at, edges) for at, _ in found]
    return [_distinct(np.concatenate([np.zeros(0, np.int32), *(b[c[k] : c[k + 1]] for (_, b), c in zip(found, cuts, strict=True))])) for k in range(len(small))]


class Model:
    def __init__(self, weights: np.ndarray, offset: float) -> None:
        self.weights, self.offset = weights.astype(np.float32), float(offset)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = features(texts)
        z = np.array([self.weights[x].sum() / np.sqrt(max(len(x), 1)) for x in found], float) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[np.ndarray], labels: list[int], rounds: int = 600, rate: float = 0.2, smooth: float = 1.0, block: int = 500) -> Model:
    """The model for feature arrays and their labels."""
    y = np.array(labels, float)
    n, positives = len(y), int(y.sum())
    if positives in (0, n):
        share = positives / n if n else 0.0
        return Model(np.zeros(BUCKETS), np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    counts = np.zeros((2, BUCKETS))
    for x, label in zip(texts, labels, strict=True):
        counts[label, x] += 1
    ratio = np.log((counts[1] + smooth) / (positives + 2 * smooth)) - np.log((counts[0] + smooth) / (n - positives + 2 * smooth))
    held, share = counts.sum(axis=0), positives / n
    deviation = np.abs(counts[1] - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    ratio *= np.maximum(deviation - ERRORS, 0) / np.maximum(deviation, 1e-9)
    ratio[held < LEAST_DOCS] = 0
    weight = np.where(y == 1, 0.5 * (n - positives) / positives, 1.0)
    weight /= weight.sum()
    # Buckets whose ratio is not zero, numbered on end; blocks of rows: owner sizes, columns, values.
    active = np.flatnonzero(ratio)
    number = np.full(BUCKETS, -1, np.int64)
    number[active] = np.arange(len(active))
    blocks = []
    for lo in range(0, n, block):
        part = [x[number[x] >= 0] for x in texts[lo : lo + block]]
        size = np.array([len(x) for x in part])
        whole = np.array([max(len(x), 1) for x in texts[lo : lo + block]])
        column = np.concatenate(part)
        value = ratio[column] / np.sqrt(np.repeat(whole, size))
        blocks.append((slice(lo, lo + len(part)), size, number[column], value.astype(np.float32)))
    w, offset = np.zeros(len(active)), 0.0
    mean, square, mean_o, square_o = np.zeros(len(active)), np.zeros(len(active)), 0.0, 0.0
    for step in range(1, rounds + 1):
        gradient, gradient_o = 1e-6 * w, 0.0
        for at, size, column, value in blocks:
            total = np.concatenate([[0.0], np.cumsum(w[column] * value)])
            end = np.cumsum(size)
            z = total[end] - total[end - size] + offset
            error = weight[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at])
            gradient += np.bincount(column, np.repeat(error, size) * value, len(active))
            gradient_o += error.sum()
        # Adam.
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        mean_o, square_o = 0.9 * mean_o + 0.1 * gradient_o, 0.99 * square_o + 0.01 * gradient_o**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (mean / a) / (np.sqrt(square / b) + 1e-8)
        offset -= rate * (mean_o / a) / (np.sqrt(square_o / b) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[active] = w * ratio[active]
    return Model(weights, offset)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, most_features: int = FEATURES) -> Model:
    """A model from the labelled texts; ``may_learn``: condition on the labels' columns."""
    rows = labels.where(F.lit(True) if may_learn is None else may_learn).where(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label in (0, 1)")
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    rows = rows.select("id", F.xxhash64("id").alias("order"), F.col("label").cast("int").alias("label"))
    chosen = [rows.where(F.col("label") == label).orderBy("order", "id").limit(most) for label, most in ((1, positives), (0, negatives))]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most positives + negatives rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("order", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("toxicity")
        for batch in batches:
            for part in pieces(batch, "text", _STEP):
                found = features(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["order", "label", "n", "found"])

    spark = docs.sparkSession
    described = texts.mapInArrow(run, "order long, label int, n long, found binary")
    described = described.groupBy("order", "label").agg(F.min(F.struct("n", "found")).alias("x")).select("order", "label", "x.*")
    described = materialise(described, "toxicity-sample")
    # At most positives + negatives rows.  The classes in turn, so that the bound on features takes from both alike.
    part_of = F.when(F.col("label") == 1, positives).otherwise(negatives)
    turn = described.select((F.row_number().over(Window.partitionBy("label").orderBy("order")) / part_of).alias("turn"), "label", "order", "n")
    use = turn.withColumn("total", F.sum("n").over(Window.orderBy("turn", "label"))).where(F.col("total") <= most_features)
    with lean(spark):
        sample = described.join(F.broadcast(use.select("label", "order")), ["label", "order"], "left_semi").orderBy("order", "label").toArrow()
    found = [np.frombuffer(x.as_buffer(), np.int32) for chunk in sample["found"].chunks for x in chunk]
    return fit(found, sample["label"].to_pylist())


def score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the model's score of each whole text, 0 to 1; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name.lower() != score_col.lower() or f.name == text_col]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("toxicity")
        for batch in batches:
            for part in pieces(batch, text_col, _STEP):
                values = model.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], [*part.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(score_col, T.DoubleType())]))
