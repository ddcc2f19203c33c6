"""Each stage, on its own input, against the brute-force versions of the other tests."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pagetide.llm import queries
from pagetide.session import store

import test_minhash
import test_substrings
import test_tiling


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], sf_dir), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity(spark, sf_dir, stages):
    before, after = texts(stages[0]), texts(stages[1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(before[i] == t for i, t in after.items())
    wrong = [i for i, t in labels.items() if (i in after) == bool(t)]
    assert len(wrong) <= 0.05 * len(labels)


def test_near_duplicates(stages):
    before, after = texts(stages[1]), texts(stages[2])
    keep = {i for i, _, root in test_minhash.brute(list(before.items()), corpus_pipeline.SHINGLE) if i == root}
    assert after == {i: before[i] for i in keep}


def test_repeated_passages(stages):
    before, after = texts(stages[2]), texts(stages[3])
    for doc_id, _, removed, kept in test_substrings.brute(list(before.items())):
        assert after[doc_id] == (kept if removed else before[doc_id])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_decontamination(spark, sf_dir, stages):
    before, after = texts(stages[3]), texts(stages[4])
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    gone = set()
    fold = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    for item in items:
        words = fold(item["text"])
        seeds = {tuple(words[p:p + 5]) for p in range(len(words) - 4)}
        for doc_id, text in before.items():
            own = fold(text)
            if any(tuple(own[p:p + 5]) in seeds for p in range(len(own) - 4)):
                if sum(test_tiling.plain_tiles(own, words, 5)) >= 0.6 * len(words):
                    gone.add(doc_id)
    assert after == {i: t for i, t in before.items() if i not in gone}


def test_tokens(stages):
    import tiktoken
    from pagetide.llm import bpe

    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        ranks = dict(bpe.read_ranks(f.read()))
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    before = texts(stages[4])
    for r in stages[5].collect():
        text = before.pop(r["doc_id"])
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not before


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = queries.QUERIES["pipeline"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[5].collect()))


def test_odd_rows(spark, stages, sf_dir):
    """Nulls, empties, repeats and an empty table pass every stage."""
    from pyspark.sql import functions as F

    docs = stages[0].limit(5)
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
                               F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
                               F.lit(None).cast("long").alias("n_chars"))
    more = store(docs.union(odd).union(odd).union(docs.limit(1).withColumn("text", F.lit(""))).union(docs), "odd")
    for frame in (more, more.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = store(stage(spark, frame, sf_dir), name)
        assert frame.count() <= more.count()


def test_near_duplicates_of_repeated_identifiers(spark, stages, sf_dir):
    """Only rows that are like another go, whatever identifier they have."""
    import random

    from helpers import prose

    rng = random.Random(6)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    like = a.replace(a.split()[30], "other", 1)
    data = [(1, a, "en", "x", 1), (2, like, "en", "x", 2), (2, b, "en", "x", 3), (2, b, "de", "w", 3), (3, "", "en", "x", 0),
            (3, c, "en", "x", 4), (3, None, "en", "x", 0), (4, b + " end", "en", "x", 5), (5, d, "en", "x", 6),
            (5, d + " and more", "en", "x", 7)]
    want = [(1, a, "en", "x", 1), (2, b, "de", "w", 3), (3, "", "en", "x", 0), (3, c, "en", "x", 4), (3, None, "en", "x", 0),
            (5, d + " and more", "en", "x", 7)]
    docs = spark.createDataFrame(data, stages[0].schema)
    for parts in (1, 4):
        got = corpus_pipeline.remove_near_duplicates(spark, docs.repartition(parts), sf_dir).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decontamination_without_identifiers(spark, sf_dir):
    """A contaminated row goes without an identifier as well, and takes no clean row along."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    data = [(None, item), (None, "nothing of it here"), (7, item), (7, "a clean text of the same identifier"), (8, None), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in data if r[1] != item), key=str)
