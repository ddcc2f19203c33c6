"""Ranked search against brute force."""

from __future__ import annotations

import math
import random
import re

import pytest

from helpers import DOCS, prose, with_clashes
from pagetide.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(d, terms_of(t)) for d, t in docs]
    bags = [(d, t) for d, t in bags if t]
    n_docs, n_terms = len(bags), sum(len(t) for _, t in bags)
    out = []
    for item, text in items:
        scored = []
        for d, t in bags:
            m, score = 100 - 50 + (50 * len(t) * n_docs) // n_terms, 0
            for term in set(terms_of(text)):
                df, tf = sum(term in b for _, b in bags), t.count(term)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda s: s[:3])
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(scored[:k], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    assert [t.decode() for t in S.terms("A-b Zürich_9x\x00ÉÉ") if t] == ["a", "b", "zürich", "9x", "ÉÉ"]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    docs = [(i * 7 % 90, prose(rng, rng.randrange(0, 60), 40)) for i in range(90)]
    docs += [(200 + i, docs[3][1]) for i in range(15)]  # ties over several blocks
    docs += [(None, docs[3][1]), (None, None), (2**53 + 1, docs[3][1]), (2**53 + 3, "w1 w2"), (300, "")]
    docs += [(400, "w5 " * 3000), (401, "W1-w2"), (401, "W1-w2")]
    items = [(i, prose(rng, 8, 50)) for i in range(6)] + [(6, None), (7, ""), (None, "w3 w4"), (8, "absent"), (1, "w9 w9"), (9, docs[3][1])]
    monkeypatch.setattr(S, "PART_TERMS", 20 if seed else S.PART_TERMS)
    monkeypatch.setattr(S, "FIRST_READ", 2)
    got = S.rank_documents(with_clashes(spark.createDataFrame(docs, DOCS).repartition(5)),
                           with_clashes(spark.createDataFrame(items, ITEMS)), k=7)
    assert rows(got) == sorted(brute(docs, items, 7), key=str)


def test_blocks_and_fewer_matches_than_asked(spark):
    docs = [(i, f"w{i % 9} common" + " x" * (i % 5)) for i in range(60)]
    items = [(1, "common w3"), (2, "w8")]
    got = S.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert rows(got) == sorted(brute(docs, items, 50), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert S.rank_documents(docs.limit(0), items).count() == 0
    assert S.rank_documents(docs, items.limit(0)).count() == 0
    assert S.rank_documents(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_stops_early():
    """With a high score to beat, lists are read no further than needed."""
    import numpy as np

    n = 5_000
    row = {"ids": range(n), "terms": np.array([0]), "starts": np.array([0, n]), "docs": np.arange(n, dtype=np.int32),
           "parts": np.arange(n, 0, -1, dtype=np.int32)}
    lists = S._Lists(row, np.array([0]), np.array([10]))
    assert list(lists.resolve(3, 0)) == [0, 1, 2] and lists.read == [S.FIRST_READ]
