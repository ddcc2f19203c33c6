"""Identifiers come back as they are, also above 2**53 and beside nulls in one batch."""

from __future__ import annotations

import pytest

import corpus_pipeline
from helpers import prose
from pagetide.llm import queries

IDS = [None, 2**53 + 1, 2**53 + 3, 5]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(4)
    root = tmp_path_factory.mktemp("tables")
    item = prose(rng, 30, 500)
    texts = [item, item, prose(rng, 120, 300), prose(rng, 80, 300)]
    docs = [(i, t, "en", "web", None if i is None else len(t) + 2**53) for i, t in zip(IDS, texts)]
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    table("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    table("pages", [(i, f"http://a.b/{i}", f"<p>{t}</p>") for i, t in zip(IDS, texts)], "page_id long, url string, html string")
    table("benchmark", [(2**53 + 5, item), (None, "")], "item_id long, text string")
    table("labels", [(5, 1, 0), (2**53 + 3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    table("embeddings", [(i, 1, [1.0, float(n)]) for n, i in enumerate(IDS)], "vec_id long, label int, embedding array<double>")
    return str(root)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("pipeline", "op13_ranked_search")])
def test_queries(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    key = df.columns[0]
    assert sorted((r[key] for r in df.collect()), key=str) == sorted(IDS, key=str)


def test_ranked_search_and_contamination(spark, folder):
    ranked = queries.QUERIES["op13_ranked_search"](spark, folder).collect()
    assert {r.item_id for r in ranked} == {2**53 + 5} and {None, 2**53 + 1} <= {r.doc_id for r in ranked}
    verdict = {r.doc_id: (r.contaminated, r.item_id) for r in queries.QUERIES["op9_greedy_tiling"](spark, folder).collect()}
    assert verdict[2**53 + 1] == (True, 2**53 + 5) and not verdict[2**53 + 3][0] and not verdict[5][0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {"near_duplicates": {2**53 + 1, 2**53 + 3, 5}, "decontamination": {2**53 + 3, 5}}.get(name, set(IDS))
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, folder).collect()
    assert {r.doc_id for r in got} == kept
    if name != "tokens":
        sizes = {r.doc_id: r.n_chars for r in docs.collect()}
        assert all(r.n_chars == sizes[r.doc_id] for r in got)
