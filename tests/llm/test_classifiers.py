from __future__ import annotations

import random
import zlib

import numpy as np
from helpers import DOCS, prose, with_clashes
from pagetide.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def test_quality_on_held_out_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(with_clashes(docs), ranking).collect()}
    assert all(r["held_out"] == (remainder(i) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
               for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = spark.createDataFrame([(i, prose(random.Random(i), 30)) for i in range(80)], DOCS)
    rows = [(i, i % 2, 0) for i in range(80)]
    flipped = [(i, 1 - q if remainder(i) == 2 else q, t) for i, q, t in rows]
    a, b = (quality.train(docs, spark.createDataFrame(x, LABELS)) for x in (rows, flipped))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y" * 200_000), (3, "y" * 200_000)], DOCS)
    empty = quality.train(docs, spark.createDataFrame([], LABELS))
    assert [r["predicted"] for r in quality.score(docs, empty).collect()] == [1] * 5
    bad = quality.train(docs, spark.createDataFrame([(i, 0, 0) for i in (1, 2, 3, None)], LABELS))
    assert {r["predicted"] for r in quality.score(docs, bad).collect()} == {0}
    assert quality.score(spark.createDataFrame([], DOCS), empty).count() == 0


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """In pieces the fit equals one over all rows at once; no labelled row is left out."""
    monkeypatch.setattr(quality, "PIECE_ROWS", 40)
    docs = spark.createDataFrame([(i, prose(random.Random(i), 30) + " |#" * (i % 5 == 0)) for i in range(400)], DOCS)
    labels = [(i, int(i % 5 > 0), 0) for i in range(400)]
    x = np.array([quality.features_of(r["text"]) for r in docs.collect() if remainder(r["doc_id"]) != 2])
    ranking = quality.train(docs, spark.createDataFrame(labels, LABELS))
    assert np.allclose(ranking.centre, np.median(x, axis=0), rtol=0, atol=1e-12)
    assert np.allclose(ranking.scale, np.maximum(x.std(axis=0), 1e-3), rtol=0, atol=1e-12)
    raw = np.sort(ranking.raw(x))
    share = np.mean([q == 0 for i, q, _ in labels if remainder(i) != 2])
    assert abs(ranking.threshold - np.quantile(raw, [share - 0.005, share + 0.005]).mean()) < 1e-9
    seen = [r["own"] for r in quality._pieces(spark.createDataFrame(
        [(i, q, quality.features_of("a b").tolist()) for i, q, _ in labels], "doc_id long, quality int, x array<double>"), 320, 80).collect()]
    assert len(seen) == 10 and sum(sum(s) for s in seen) == 400


def test_quality_reads_more_labels_than_one_fit_holds(spark):
    """The features behind the threshold come from all of 30,000 labelled rows."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('word ', CAST(1 + id % 300 AS INT)) AS text")
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 300 >= 100 AS INT) AS quality", "0 AS toxic")
    ranking = quality.train(docs, labels)
    sizes = [quality.features_of("word " * (1 + k))[-1] for k in range(300)]
    kept = [sizes[i % 300] for i in range(30_000) if remainder(i) != 2]
    assert ranking.centre[-1] == np.median(kept) and np.isclose(ranking.scale[-1], np.std(kept), rtol=1e-9)


def toxic_corpus(seed=13, n=600):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 120)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Zorg", "blarf!", "snurk" + rng.choice(["ing", "ed", "s", "ish"])]))
        data.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return data, labels


def test_toxicity_on_unseen_documents(spark):
    data, labels = toxic_corpus()
    docs = with_clashes(spark.createDataFrame(data, DOCS).withColumnRenamed("n", "n2")).drop("toxic")
    chain = toxicity.train(docs, spark.createDataFrame([x for x in labels if x[0] < 400], LABELS))
    new = spark.createDataFrame(data[400:] + [(9001, "You snurkest"), (9002, None), (9003, ""), (None, "zorg zorg blarf")], DOCS)
    got = {r["doc_id"]: r for r in toxicity.score(new, chain).collect()}
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in labels[400:]]) == 1.0
    assert got[9001]["toxic"] and got[None]["toxic"] and not got[9002]["toxic"] and not got[9003]["toxic"]
    assert got[None]["p_insult"] > 0.5


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(14)
    x = rng.integers(0, 2, (300, 6)).astype(np.float32)
    y = np.stack([x[:, 0], x[:, 0] * x[:, 1], x[:, 0]], axis=1)
    chain = toxicity.train_chain(None, x, y, np.arange(300) % 3)
    assert [len(w) for w in chain.weights] == [7, 8, 9]
    assert ((chain.predict(x) > 0.5) == (y > 0.5)).mean() > 0.98


def test_toxicity_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], DOCS)
    for labels in ([], [(1, 1, 0), (3, 1, 0)], [(None, 1, 1), (2, 1, None), (77, 1, 1)]):
        got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, LABELS)))
        assert not any(r["toxic"] for r in got.collect())
    assert toxicity.score(spark.createDataFrame([], DOCS), toxicity.train(docs, spark.createDataFrame([], LABELS))).count() == 0


def test_features_while_the_tables_fill_up(monkeypatch):
    """Only words with a term are looked at one by one; what is remembered does not change features."""
    import pandas as pd

    monkeypatch.setattr(toxicity, "REMEMBERED_WORDS", 8)
    chosen = pd.DataFrame({"term": ["bad", "bad-", "wor-", "é", "worse", "awful-"], "z": [9.0, 8.0, 7.0, 2.9, 3.0, 3.0]})
    features = toxicity.Features(chosen)
    texts = [None, "", "Bad, badly; WORSE", "wo bade é worst baddest baden word", "bax worm _awfully_ good", "fine words"] * 3
    x, distinct = features.matrix(texts)
    for row, text in enumerate(texts):
        words = toxicity.words_of(text)
        terms = [{t for t in toxicity.terms_of(w) if t in features.place} for w in words]
        want = {features.place[t] for own in terms for t in own}
        assert set(np.flatnonzero(x[row, :-1]).tolist()) == want
        assert distinct[row] == sum(bool(own & {"bad", "bad-", "wor-"}) for own in terms)
    assert len(features.known) + len(features.plain) <= 8 and "good" not in features.plain
