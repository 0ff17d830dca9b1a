"""Personal data, URL rules, toxicity, quality, packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockmatch.llm import decontamination, pii, quality, queries, toxicity, url_filter
from blockmatch.llm.decontamination import Index, contaminated, find_items
from blockmatch.llm.packing import Encoder, pack
from blockmatch.llm.textarrays import text_shingles

EDGE = [(1, None), (2, ""), (3, " "), (None, "one two"), (4, "one two"), (4, "one two")]


def test_pii_equals_the_regular_expressions():
    rng = random.Random(1)
    letters = "0123456789" * 2 + "..  --++@@aZ:()/_%é\n"
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == pii.brute_force(text), text


def test_pii_adds_validated_accounts_and_logins():
    found = pii.find_spans("IBAN: DE89 3704 0044 0532 0130 00, SSN 123-45-6789, account no. 12345678901, see https://bob:pw1@host.example.com/x é a@b.cd")
    assert [k for k, _, _ in found] == ["account", "account", "account", "address", "email", "email"]
    assert pii.find_spans("IBAN: DE88 3704 0044 0532 0130 00 SSN 000-45-6789 account 12 https://host.example.com") == []


def test_pii_table(spark):
    out = pii.find_pii(documents(spark, [*EDGE, (5, "x" * 300_000 + " a@b.cd")])).collect()
    assert len(out) == 7 and [(s["kind"], s["start"], s["end"]) for s in next(r for r in out if r["doc_id"] == 5)["spans"]] == [("email", 300_001, 300_007)]
    assert pii.find_pii(documents(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("https://x.www.example.com/en/a", "x.www.example.com", "/en/a", "www.example.com/en/"),
        ("ftp://other.com/en", "other.com", "/en", "com/"),
        ("http://other.com", "other.com", "", None),
        ("http://x.net/es/?q", "x.net", "/es/", "net/es/"),
        ("http://notnet/es/", "notnet", "/es/", None),
        (None, "", "", None),
        ("no scheme", "", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
    ],
)
def test_url_rules(url, host, path, rule):
    assert url_filter.split_url(url) == (host, path)
    found = url_filter.best_rule(host, path, queries.URL_RULES)
    assert (found and found[1] + found[2]) == rule


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://x.net/fr/1", "h"), (2, None, "h"), (None, "http://casino-bets.example.org/win", "h"), (3, "http://city-library.example.org/books", "h")], "page_id long, url string, host string")
    out = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert out["http://x.net/fr/1"] == ("net/fr/", "block") and out["http://casino-bets.example.org/win"] == (None, "block")
    assert out["http://city-library.example.org/books"] == (None, "allow") and out[None][0] is None
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES).collect() == []
    model = url_filter.train()
    assert all((model.score(*url_filter.split_url(u)) >= 0.5) == bool(y) for u, y in url_filter.LABELLED)


def test_url_scores_equal_plain_ones(spark):
    """Of the model's weights, for repeated, null, very long and strange URLs."""
    rng = random.Random(11)
    urls = [None, "", "no scheme", "http://", "http://a/", "http://A.b.C/x?y", "http://poker24.example/bonus#1", "x://" + "ab." * 50_000 + "com/" + "p" * 100_000]
    urls += ["http://" + "".join(rng.choice("abc.-/?#é") for _ in range(rng.randrange(30))) for _ in range(200)]
    model = url_filter.train()
    out = url_filter.filter_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls * 2)], "page_id long, url string"), ()).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        host, path = url_filter.split_url(r["url"])
        z = model.offset
        for kind, words in (("h", host.split(".")[:-1] or host.split(".")), ("p", [path])):
            grams = [f"^{w}$"[i : i + n] for w in words for n in url_filter.SIZES for i in range(len(w) + 3 - n)]
            z += sum(model.weights[zlib.crc32(f"{kind}{g}".encode()) % url_filter.BUCKETS] for g in grams) / max(len(grams), 1) ** 0.5
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z))) and r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_url_training_is_at_its_optimum():
    """A regularised logistic loss with sides of equal weight: no weight nor the offset can be moved to lower it by much."""
    rows = [(url_filter.features(*url_filter.split_url(u)), y) for u, y in url_filter.LABELLED]
    model = url_filter.train()
    w = model.weights
    z = np.array([sum(w[list(side)].sum() / np.sqrt(len(side)) for side in sides if side) for sides, _ in rows]) + model.offset
    y = np.array([y for _, y in rows])
    error = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * (1 / (1 + np.exp(-z)) - y)
    slope = url_filter.L2 * w
    for (sides, _), e in zip(rows, error, strict=True):
        for side in sides:
            np.add.at(slope, side, e / np.sqrt(max(len(side), 1)))
    assert np.abs(slope).max() < 2e-3 and abs(error.sum()) < 2e-3


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = list(EDGE), [(4, 0)]
    for k in range(100, 100 + n):
        toxic = k % 4 == 0
        text = words(rng, 60, 800) + ([rng.choice(["vileness", "vilest", "vilely"])] * 2 if toxic else [])
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (5000, 7)], "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, may_learn=~queries.held_out())
    out = toxicity.score(docs, model, "rating").join(labels, "doc_id").select("doc_id", "rating", "toxic").collect()
    unseen = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] >= 100]
    right = np.mean([(r["rating"] >= 0.3) == bool(r["toxic"]) for r in unseen])
    assert len(unseen) > 50 and right > 0.95 and all(0 <= r["rating"] <= 1 for r in out)
    scores = {(r["doc_id"], r["text"]): r["rating"] for r in toxicity.score(docs, model, "rating").collect()}
    assert scores[1, None] == scores[2, ""] == scores[3, " "]
    assert set(toxicity.score(docs, model, "rating").columns) == {*docs.columns, "rating"}
    again = toxicity.score(docs, model, "SCORE")
    assert again.columns == [*(c for c in docs.columns if c != "score"), "SCORE"] and {r["SCORE"] for r in again.collect()} == {r["rating"] for r in toxicity.score(docs, model, "rating").collect()}


def plain_buckets(text):
    out = set()
    for word in (text or "").lower().split():
        for n in toxicity.SIZES:
            for i in range(len(word) + 3 - n):
                h = (sum((ord(c) + 1) * int(toxicity._COEF[k]) for k, c in enumerate(f" {word} "[i : i + n], 1)) + n) * 0x85EBCA6B % (1 << 32)
                h = (h ^ (h >> 15)) * 0xC2B2AE35 % (1 << 32)
                out.add((h ^ (h >> 16)) % toxicity.BUCKETS)
    return out


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_toxicity_features_equal_plain_ones(monkeypatch, step):
    """Whatever the step that long texts go through in."""
    monkeypatch.setattr(toxicity, "_STEP", step)
    texts = [None, "", " ", "a", "a b", "Hello  world\n ab\u3000ccc\x1cd", "\u65e5\u672c \u00c9\u00fc\u0130x word", "same same SAME", "x" * 50, "tail "]
    for part in (texts, texts[::-1], []):
        found = toxicity.features(part)
        assert [set(x.tolist()) for x in found] == [plain_buckets(t) for t in part]
        assert all(len(x) == len(set(x.tolist())) for x in found)


def test_toxicity_sample_is_bounded(spark):
    """Hot ids count once, ids labelled both ways not at all, and the bound on features holds; ids may be strings."""
    docs, labels = labelled(spark, 40)
    docs = docs.unionByName(docs.where("doc_id = 100").withColumn("text", F.lit("again "))).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = labels.unionByName(labels.where("doc_id = 101").withColumn("toxic", 1 - F.col("toxic"))).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda texts, marks: seen.append((texts, marks)) or fit(texts, marks, rounds=3)
    try:
        toxicity.train(docs, labels)
        toxicity.train(docs, labels, most_features=1500)
        toxicity.train(docs, labels, positives=3, negatives=2)
    finally:
        toxicity.fit = fit
    everything, few, three = seen
    assert len(everything[1]) == 40 and sum(everything[1]) == 10 and min(map(len, everything[0])) < 20
    assert 0 < sum(map(len, few[0])) <= 1500 and 0 < sum(few[1]) < len(few[1]) and sorted(three[1]) == [0, 0, 1, 1, 1]


def test_toxicity_of_a_very_long_text(spark):
    docs, labels = labelled(spark, 60)
    model = toxicity.train(docs, labels)
    text = " ".join(words(random.Random(7), 200_000))
    out = toxicity.score(documents(spark, [(1, text), (1, text), (2, None)]), model, "rating").collect()
    assert len({r["rating"] for r in out if r["doc_id"] == 1}) == 1 and out[0]["rating"] == pytest.approx(model.scores([text])[0])


def test_toxicity_without_examples(spark):
    docs, labels = labelled(spark, 20)
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r["rating"] for r in toxicity.score(docs, model, "rating").collect()) < 0.01
    assert toxicity.score(documents(spark, []), model, "rating").collect() == []


def test_quality(spark):
    rng = random.Random(3)
    good = [" ".join(f"{a}{b}" for a, b in zip(words(rng, 50), rng.choices(["", "", ",", "."], k=50), strict=True)).replace("w", "letters").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(200)]
    poor = [t.replace(" ", "*** ") for t in good[:20]] + [" ".join(w.upper() + "!!" for w in t.split()) for t in good[20:40]] + [" ".join(w for w in t.split()[:20] for _ in range(6)) for t in good[40:60]]
    rows = EDGE + [(100 + k, t) for k, t in enumerate(good)] + [(1000 + k, t) for k, t in enumerate(poor)]
    scored, model = quality.quality(documents(spark, rows))
    out = {r["doc_id"]: r["score"] for r in scored.collect() if r["doc_id"] is not None}
    assert all(out[100 + k] >= 0.5 for k in range(200)) and sum(out[1000 + k] < 0.5 for k in range(60)) >= 57
    assert min(model.accuracies().values()) > 0.5 and abs(model.share.sum() - 1) < 0.01
    empty, _ = quality.quality(documents(spark, []))
    assert empty.collect() == []


def test_votes_abstain_without_words():
    assert (quality.vote(pa.array([None, "", " \n"], pa.string())) == -1).all()


def test_encoder_equals_the_library():
    tool, library = Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(4)
    letters = [*"abé\u0301 \x1c\x1f\n\t\u00a0\u3000ß'sΣςİ12!?\ufb01\u200b漢\x85\x0b\x0c", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'re", "'S"]
    assert tool.by_word
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        ids = np.frombuffer(tool.encode([text])[0], tool.dtype).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
    library.encode_special_tokens = True
    literal, text = Encoder(queries.tokenizer_path(), literal_specials=True), "a <|endoftext|> b"
    assert np.frombuffer(literal.encode([text])[0], tool.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_keeps_every_id_in_one_piece(spark):
    rng = random.Random(5)
    rows = EDGE + [(10 + k, " ".join(words(rng, rng.choice([1, 40, 400, 3000])))) for k in range(30)] + [(90, "one <|endoftext|> two"), (91, " ".join(words(rng, 150_000)))]
    out = pack(documents(spark, rows).repartition(5), queries.tokenizer_path()).collect()
    tool, library = Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    sequences, docs = {}, {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_length"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for k, parts in sequences.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == max(sequences)
        assert {p for _, _, p in parts} == {at if at & (at - 1) == 0 else 2048}
    for (i, n), parts in docs.items():
        if i is not None and i >= 10:
            ids = np.frombuffer(b"".join(x for _, x in sorted(parts)), "<u4")
            text = next(t for d, t in rows if d == i)
            assert len(ids) == n and ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert [bytes(x) for _, x in docs[1, 1]] == [b"\1\0\0\0"] and len(docs[4, docs_tokens(tool, "one two")]) == 2
    assert pack(documents(spark, []), queries.tokenizer_path()).collect() == []


def docs_tokens(tool, text):
    return len(tool.encode([text])[0]) // 2 + 1


@pytest.mark.parametrize("length", [5, 6, 8, 12])
def test_smallest_items_are_all_found(length):
    rng = random.Random(length)
    items = [words(rng, length) for _ in range(1000)]
    texts = [" ".join(item + words(rng, 60)) if k % 2 else " ".join(words(rng, 40) + item + words(rng, 40)) for k, item in enumerate(items)]
    h, first = text_shingles(pa.array([" ".join(x) for x in items]), 5)
    index = Index([(k, np.unique(h[a:z]).tobytes()) for k, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True))])
    found = index.search(pa.array(texts), 5, (80, 100))
    assert [k for k, hits in enumerate(found) if k not in [x["item"] for x in hits]] == []


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.choice([8, 20, 60])))) for k in range(40)] + [(100, None), (101, ""), (102, "one two"), (103, "other short")]
    rows = list(EDGE)
    for k in range(60):
        text = words(rng, rng.choice([10, 200, 4000]))
        if k % 3 == 0:
            item = items[k % 40][1].split()
            if k % 2:
                item[0] = "changed"  # loses one shingle
            at = rng.randrange(len(text))
            text[at:at] = item
        rows.append((10 + k, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def plain(text):
        w = (text or "").split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {(i, t): sorted(n for n, x in items if plain(x) and 100 * len(plain(x) & plain(t)) >= 80 * len(plain(x))) for i, t in rows}
    for blocks in (1 << 20, 300):
        out = find_items(documents(spark, rows), bench, "found", block_shingles=blocks).collect()
        assert {(r["doc_id"], r["text"]): [h["item"] for h in r["found"]] for r in out} == want and len(out) == len(rows)
    assert sum(bool(x) for x in want.values()) >= 12
    assert find_items(documents(spark, rows), bench.limit(0), "found").where(contaminated("found")).count() == 0
    assert find_items(documents(spark, []), bench, "found").collect() == []
    again = find_items(documents(spark, rows), bench.selectExpr("'i' || item_id as item_id", "text"), "Hits")
    assert again.columns == [*(c for c in again.columns if c.lower() != "hits"), "Hits"]
    assert {(r["doc_id"], r["text"]): sorted(h["item"] for h in r["Hits"]) for r in again.collect()} == {k: sorted(f"i{n}" for n in v) for k, v in want.items()}


@pytest.mark.parametrize("run", [64, 1 << 15])
def test_items_in_a_very_long_text(monkeypatch, run):
    """Repeated items too, whatever the number of shingles that are looked at together."""
    monkeypatch.setattr(decontamination, "_RUN", run)
    rng = random.Random(8)
    text = words(rng, 100_000, 10**6)
    items = [text[k : k + n] for k, n in ((5, 9), (50_000, 40), (99_000, 300), (99_980, 20))] * 2 + [words(rng, 30)]
    h, first = text_shingles(pa.array([" ".join(x) for x in items]), 5)
    index = Index([(k, np.unique(h[a:z]).tobytes()) for k, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True))])
    found = index.search(pa.array([" ".join(text), None]), 5, (80, 100))
    assert sorted(x["item"] for x in found[0]) == [0, 1, 2, 3, 4, 5, 6, 7] and found[1] == []
