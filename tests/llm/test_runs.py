"""Runs and Lyndon arrays against their definitions."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import DOCS, with_clashes
from pagetide.llm import runs as R


def longest_lyndon(ranks):
    def is_lyndon(w):
        return all(w < w[i:] for i in range(1, len(w)))

    return [max(n for n in range(1, len(ranks) - i + 1) if is_lyndon(ranks[i:i + n])) for i in range(len(ranks))]


def plain_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and (i, j + q - i) not in found:
                found[i, j + q - i] = q  # periods ascend, so the first is the smallest
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_array(values):
    ranks = [sorted(set(values)).index(v) for v in values]
    lengths, roots = R.lyndon_array(ranks)
    assert lengths == longest_lyndon(ranks)
    for i in range(len(ranks)):
        for j in range(len(ranks)):
            same = ranks[i:i + lengths[i]] == ranks[j:j + lengths[j]]
            assert (roots[i] == roots[j]) == same


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (2, 2), (5, 3), (9, 5)]))
def test_runs_of_short_alphabets(words, law):
    assert R.runs(words, *law) == plain_runs(words, *law)


@pytest.mark.parametrize("seed", range(30))
def test_planted_and_nested_runs(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(6):
        block = [rng.randrange(6) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 6)
        words += block * rng.randrange(1, 6) + [rng.randrange(50) for _ in range(rng.randrange(8))]
    assert R.runs(words) == plain_runs(words)


def test_long_sequences_are_linear():
    import time

    start = time.perf_counter()
    assert R.runs(["a"] * 100_000) == [(0, 100_000, 1)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 60_000:
        fib.append(fib[-1] + fib[-2])
    assert R.runs(list(fib[-1])) == []  # no fourth powers
    assert time.perf_counter() - start < 20


def test_find(spark):
    rows = [(1, "x " + "a b " * 5 + "c"), (None, "q " * 7), (2, None), (3, ""), (4, "no runs here"),
            (2**53 + 1, "\ta\nb " * 4), (1, "x " + "a b " * 5 + "c"), (5, "ä\u00a0b " * 6)]
    df = with_clashes(spark.createDataFrame(rows, DOCS)).withColumn("runs", F.lit(1))
    got = R.find(df).collect()
    assert len(got) == len(rows) and set(df.columns) < {"collapsed", "n_words", *df.columns} == set(got[0].asDict())
    by = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in got}
    assert by[1, rows[0][1]] == ([(1, 10, 2)], "x a b c", 12)
    assert by[None, "q " * 7] == ([(0, 7, 1)], "q", 7)
    assert by[2, None] == ([], "", 0) and by[3, ""] == ([], "", 0)
    assert by[4, "no runs here"] == ([], "no runs here", 3)
    assert by[2**53 + 1, "\ta\nb " * 4] == ([(0, 8, 2)], "a b", 8)
    assert by[5, "ä\u00a0b " * 6] == ([(0, 6, 1)], "ä\u00a0b", 6)
    assert R.find(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.find(df, times=1)
