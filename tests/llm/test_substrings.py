from __future__ import annotations

import random
import re

import numpy as np
from helpers import DOCS, prose, with_clashes
from pagetide.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(data):
    first = {}
    for doc_id, text in data:
        words = WORD.findall(text or "")
        for p in range(len(words) - 49):
            key = tuple(words[p:p + 50])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in data:
        words = WORD.findall(text or "")
        keep = [True] * len(words)
        for p in range(len(words) - 49):
            if doc_id is not None and first[tuple(words[p:p + 50])] < doc_id:
                keep[p:p + 50] = [False] * 50
        kept = [w for w, k in zip(words, keep) if k]
        out.append((doc_id, len(words), len(words) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(45, 200)) for _ in range(8)]
    data = []
    for i in range(150):
        parts = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            words = rng.choice(passages).split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "changed"
            if rng.random() < 0.4:
                words = words[rng.randrange(20):]
            parts.insert(rng.randrange(len(parts)), " ".join(words))
        data.append((i * 3, rng.choice([" ", "\n", "\t "]).join(parts)))
    # A passage in most documents, copies, near copies, runs of one word, and odd rows.
    data += [(1000 + i, prose(rng, 5) + " " + passages[0] + " " + prose(rng, 5)) for i in range(80)]
    data += [(2000 + i, passages[1] + " " + passages[2]) for i in range(30)]
    base = prose(rng, 300).split()
    for i in range(30):
        words = list(base)
        words[rng.randrange(300)] = f"v{i}"
        data.append((3000 + i, " ".join(words)))
    data += [(4000, "la " * 120), (4001, "la " * 70 + "lo " * 90), (4002, "lo " * 60), (4003, "ab cd " * 60), (4004, "cd ab " * 55)]
    data += [(5000, None), (5001, ""), (5002, " \n "), (5003, passages[1]), (5003, passages[1]), (None, passages[1]),
             (5004, " ".join(["nbsp"] * 80)), (5005, " ".join(["nbsp"] * 80)), (5006, passages[3]), (5006, passages[4])]
    return data


def test_against_brute_force(spark):
    for seed in (1, 2):
        data = made(seed)
        docs = with_clashes(spark.createDataFrame(data, DOCS).repartition(5))
        got = substrings.cut(docs, substrings.repeats(docs)).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(data)


def test_other_columns_stay_and_empty(spark):
    docs = with_clashes(spark.createDataFrame(made(3)[:40], DOCS))
    out = substrings.cut(docs, substrings.repeats(docs))
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    empty = spark.createDataFrame([], DOCS)
    assert substrings.cut(empty, substrings.repeats(empty)).count() == 0


def test_every_window_has_the_anchor_that_its_words_decide():
    rng = np.random.default_rng(9)
    words = rng.integers(0, 2**64, 400, dtype=np.uint64)
    shared = words[100:190]
    for text in (words, np.concatenate([words[300:], shared, words[:50]])):
        anchor, _, first, last = substrings.stretches(text)
        assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
    own = {int(a) for a in substrings.stretches(shared)[0]}
    assert own <= {int(a) for a in substrings.stretches(words)[0]}


def test_stretches_of_many_texts_at_once():
    rng = np.random.default_rng(10)
    texts = [rng.integers(0, 4, n, dtype=np.uint64) for n in (0, 49, 50, 300, 0, 51, 120, 7)]
    bounds = np.cumsum([0, *map(len, texts)])
    text, *found = substrings.all_stretches(np.concatenate(texts), bounds)
    for i, own in enumerate(texts):
        assert all((a[text == i] == b).all() for a, b in zip(found, substrings.stretches(own)))
    assert set(text.tolist()) == {2, 3, 5, 6}


def test_rows_that_lose_nothing_are_not_cut(spark):
    """What the pipeline cuts are the rows listed; the others are those of ``cut`` that lose nothing."""
    docs = with_clashes(spark.createDataFrame(made(4), DOCS).repartition(3))
    found = substrings.store(substrings.repeats(docs), "repeats")
    listed = {r["doc_id"] for r in found.collect()}
    columns = ["doc_id", "n_words", "n_removed", "kept"]
    got = substrings.cut_listed(docs, found).select(*columns).collect()
    assert {r["doc_id"] for r in got} >= listed and len(got) < docs.count() / 1.2
    rest = substrings.filtered(docs, found, "doc_id", keep=False)
    assert len(got) + rest.count() == docs.count()
    whole = sorted(map(tuple, substrings.cut(docs, found).select(*columns).collect()), key=str)
    assert [r for r in whole if r[2]] == sorted((tuple(r) for r in got if r["n_removed"]), key=str)
