"""The corpus pipeline against plain versions of its stages, and queries against each other."""

import random

import corpus_pipeline
from helpers import words
from test_dedup import plain_near

from blockmatch.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, row_key long"


def make(spark, path):
    rng = random.Random(1)
    rows, labels = [(1, None), (2, ""), (None, None), (3, "two words"), (3, "two words"), (None, "null id text of some words")], []
    items = [(k, " ".join(words(rng, 30))) for k in range(5)]
    for k in range(10, 250):
        text = words(rng, 80, 900)
        if k % 5 == 0:
            text += ["vileness", "vilest"]
        elif k % 11 == 0:
            text[40:40] = items[k % 5][1].split()
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(k % 5 == 0)))
        if k % 7 == 0:
            rows.append((1000 + k, " ".join(text)))
        if k % 9 == 0:
            rows.append((2000 + k, " ".join([*text[:-1], "edited"])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "h", 1) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, dict((i, x) for i, _, x in labels), items


def ids(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    rows, toxic, items = make(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

    clean = stages["toxicity"](spark, docs, path)
    assert clean.columns == columns
    kept = clean.collect()
    wrong = [r["doc_id"] for r in kept if toxic.get((r["doc_id"] or 0) % 1000 if (r["doc_id"] or 0) >= 1000 else r["doc_id"]) == 1]
    assert len(wrong) <= 4 and len(kept) >= sum(not (t or "").count("vile") for _, t in rows)

    once = stages["exact_dedup"](spark, docs, path)
    best = {}
    for i, t in rows:
        best[t or ""] = max((x for x in (i, best.get(t or "")) if x is not None), default=None)
    assert once.columns == columns and sorted(((i, t) for t, i in best.items()), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in once.collect()), key=str)

    single = [(i, t) for t, i in best.items()]
    few = stages["near_dedup"](spark, once, path)
    plain = plain_near(single, 5)
    assert few.columns == columns
    with_id = sorted(i for (i, _), (_, n, c) in zip(single, plain, strict=True) if i is not None and (n == 0 or i == c))
    assert sorted(r["doc_id"] for r in few.collect() if r["doc_id"] is not None) == with_id

    rest = stages["decontamination"](spark, docs, path)
    held = [(i, t) for i, t in rows if any(x in (t or "") for _, x in items)]
    assert held and rest.columns == columns and ids(rest.collect()) == sorted((r for r in rows if r not in held), key=str)


def test_run_and_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    make(spark, path)
    out = corpus_pipeline.run(spark, path).collect()
    assert out and {r["length"] > 0 for r in out} == {True}
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.collect() == []


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names and corpus_pipeline.ORACLE_SQL is None
    assert set(queries.oracle_sql()) <= set(queries.queries())
