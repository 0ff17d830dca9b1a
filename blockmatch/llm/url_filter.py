"""URL filter: host and path rules, and a model for what no rule fits.

The model is a logistic regression on hashed character n-grams of the host's
labels and of the path, trained on a small table of labelled URLs that is a
parameter (``LABELLED`` is the built-in one).  Training is full-batch from zero
weights, so it always gives the same model; the weights, one float for each hash
bucket, go to the executors with the function.

A rule is (action, host, path).  It fits its host and every subdomain of it, if
the URL's path starts with the rule's path; of several the longest wins (host
and path together, then the longer host).

Defined results: a null URL, or one without ``://``, has empty host and path and
is judged by the model like any other; repeated rows are judged alike; an empty
table gives an empty result; a null id is kept as it is; only the id and URL
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: A URL is blocked from this probability on.
THRESHOLD = 0.5
#: Regularisation, chosen by cross-validation over the table's words.
L2 = 3e-4
#: Host scores that one worker remembers at most.
REMEMBERED = 200_000

#: Words of the built-in table, by general knowledge of what URL filters block and what sites are named after.
_BLOCK_WORDS = """
casino poker roulette blackjack jackpot slots betting bookmaker lottery bingo wager gambling
viagra cialis pharmacy pills tablets steroids painkillers dietpills replica counterfeit
porn xxx sex escort webcam nude erotic fetish adult hookup
adserver adclick banner popunder tracker tracking clickbait affiliate
spam linkfarm backlinks spammer phishing malware ransomware keylogger trojan scam
warez crack keygen torrent payday loans getrich moneymaker
""".split()

_ALLOW_WORDS = """
news herald gazette times weather climate library archive university college school teacher museum gallery history science journal research physics
chemistry biology medicine hospital clinic nurse railway airport harbour traffic council parliament justice police police-station fire-brigade army embassy
travel hiking sailing cycling football rugby tennis chess recipes bakery kitchen cheese coffee garden flowers farm orchard forest river mountain island
music orchestra choir theatre cinema photo painting poetry books novel letters language grammar dictionary wiki forum blog diary notes manual docs
python compiler kernel database network server cloud storage energy solar bank insurance pension tax lawyer builder carpenter plumber factory steel
""".split()

_FORMS = ("{}", "{}-online", "my{}", "{}24", "{}-world", "the{}", "{}-site", "{}s-portal")
_BLOCK_PATHS = ("", "/", "/bonus", "/signup?ref=9", "/click?id=1", "/pixel.gif", "/video/1", "/order")
_ALLOW_PATHS = ("", "/", "/12", "/345.html", "/about", "/2019/05/story.html", "/articles/a-1", "/index.php?p=3")


def _names(n: int, seed: int = 1) -> list[str]:
    """Names without a meaning, as most sites have: two to four syllables by chance."""
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "l"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]


#: (URL, 1 for block): each word in four forms of its host, once with a path of its side and else with ordinary ones in turn, so
#: the path alone weighs little; most hosts are names and ordinary words, as on the web.
LABELLED: tuple[tuple[str, int], ...] = tuple(
    (f"http://{_FORMS[(i + 2 * k) % len(_FORMS)].format(word)}.example{(_ALLOW_PATHS if k else paths)[(i + k) % len(paths)]}", label)
    for label, words, paths in ((1, _BLOCK_WORDS, _BLOCK_PATHS), (0, _ALLOW_WORDS + _names(200), _ALLOW_PATHS))
    for i, word in enumerate(words)
    for k in range(4)
)

_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z made small) and path."""
    found = _URL.search(url or "")
    return (found[1].translate(_CAPITALS), found[2]) if found else ("", "")


def _buckets(text: str, kind: str) -> list[int]:
    text = f"^{text}$"
    return [zlib.crc32(f"{kind}{text[i : i + n]}".encode()) % BUCKETS for n in SIZES for i in range(len(text) - n + 1)]


def features(host: str, path: str) -> tuple[list[int], list[int]]:
    """Buckets of the host's labels (the last, the top-level domain, tells nothing) and of the path."""
    labels = host.split(".")
    return [b for label in labels[:-1] or labels for b in _buckets(label, "h")], _buckets(path, "p")


class Model:
    """Weights and offset; a side's weights are averaged with the root of its n-gram count."""

    def __init__(self, weights: np.ndarray, offset: float) -> None:
        self.weights, self.offset, self.hosts = weights, offset, {}

    def side(self, buckets: list[int]) -> float:
        return float(self.weights[buckets].sum() / np.sqrt(len(buckets))) if buckets else 0.0

    def score(self, host: str, path: str) -> float:
        if host not in self.hosts:
            if len(self.hosts) >= REMEMBERED:
                self.hosts.clear()
            self.hosts[host] = self.side(features(host, "")[0])
        return float(1 / (1 + np.exp(-(self.hosts[host] + self.side(_buckets(path, "p")) + self.offset))))


def train(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = 400, rate: float = 0.05, l2: float = L2) -> Model:
    rows, columns, values = [], [], []
    for i, (url, _) in enumerate(labelled):
        for side in features(*split_url(url)):
            rows += [i] * len(side)
            columns += side
            values += [1 / np.sqrt(len(side) or 1)] * len(side)
    used, c = np.unique(np.array(columns, int), return_inverse=True)
    r, v = np.array(rows, int), np.array(values)
    y = np.array([label for _, label in labelled], float)
    # Both sides weigh the same.
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, mean, square = np.zeros((3, len(used) + 1))  # the last one is the offset
    for step in range(1, rounds + 1):
        z = np.bincount(r, w[c] * v, len(y)) + w[-1]
        error = weight * (1 / (1 + np.exp(-z)) - y)
        gradient = np.append(np.bincount(c, error[r] * v, len(used)) + l2 * w[:-1], error.sum())
        # Adam.
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w - rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def best_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str, str] | None:
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), default=None)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", labelled: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """(id, url, host, path, rule, score, verdict): the rule's action, else the model's."""
    model = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, score = best_rule(host, path, rules), model.score(host, path)
                out.append((host, path, rule and rule[1] + rule[2], score, rule[0] if rule else ("block" if score >= THRESHOLD else "allow")))
            kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "url", "host", "path", "rule", "score", "verdict"])

    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    text = [T.StructField(c, T.DoubleType() if c == "score" else T.StringType()) for c in ("url", "host", "path", "rule", "score", "verdict")]
    return pages.mapInArrow(run, T.StructType([T.StructField("id", pages.schema["id"].dataType), *text])).withColumnRenamed("id", id_col)
