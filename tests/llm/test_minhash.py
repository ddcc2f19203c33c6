from __future__ import annotations

import random
import re

import numpy as np
from helpers import DOCS, prose, roots, with_clashes
from pagetide.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[p:p + k]) for p in range(len(words) - k + 1))


def brute(data, k):
    sets = {i: shingle_set(t, k) for i, t in data}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return sorted((i, len(sets[i]), root[i]) for i in ids)


def made(seed):
    rng = random.Random(seed)
    data = []
    for _ in range(60):
        base = prose(rng, rng.randrange(3, 150)).split()
        for _ in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            data.append((len(data), " ".join(words)))
    # A large group of near copies: not all of them link with the first.
    base = prose(rng, 120).split()
    for _ in range(120):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(120)] = f"y{rng.randrange(999)}"
        data.append((len(data), " ".join(words)))
    data += [(len(data) + i, base[0].upper() + " " + " ".join(base[1:])) for i in range(50)]
    data += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "Été"), (9007, "été")]
    return data


def test_against_brute_force(spark):
    for seed, k in ((1, 4), (2, 5)):
        data = made(seed)
        docs = with_clashes(spark.createDataFrame(data, DOCS).repartition(4))
        got = minhash.near_duplicates(docs, k).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute(data, k)


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    data = made(3)
    got = minhash.near_duplicates(spark.createDataFrame(data, DOCS), 4).collect()
    assert sorted(map(tuple, got)) == brute(data, 4)


def test_repeats_missing_identifiers_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = minhash.near_duplicates(spark.createDataFrame(
        [(1, text), (1, text), (4, text + " end"), (None, text), (None, "alone in the world here")], DOCS), 4)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str) == sorted(
        [(1, 1), (1, 1), (4, 1), (None, 1), (None, None)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS), 4).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(10)
    errors = []
    for _ in range(200):
        shared = rng.integers(0, 2**64, 300, dtype=np.uint64)
        a = np.concatenate([shared, rng.integers(0, 2**64, 60, dtype=np.uint64)])
        b = np.concatenate([shared, rng.integers(0, 2**64, 60, dtype=np.uint64)])
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 300 / 420)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_unequal_texts_of_one_identifier(spark):
    """Every text of an identifier can link, and its rows are one document."""
    rng = random.Random(5)
    data = [(i, prose(rng, 60)) for i in range(1, 9)]
    near = [t.replace(t.split()[30], "other", 1) for _, t in data]
    data += [(20, near[0]), (20, near[1]), (20, ""), (21, data[2][1]), (21, prose(rng, 60)), (22, near[3]), (22, near[3]),
             (3, near[4]), (30, prose(rng, 60)), (30, prose(rng, 60)), (2**61 + 1, near[5]), (2**61 + 1, None), (None, near[6])]
    sets = [shingle_set(t, 4) for _, t in data]
    ids = sorted(i for i, _ in data if i)
    links = [(data[a][0] or 2**62, data[b][0] or 2**62) for a in range(len(data)) for b in range(a)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots([*ids, 2**62], links)
    got = minhash.near_duplicates(spark.createDataFrame(data, DOCS).repartition(4), 4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(i, len(s), root[i or 2**62]) for (i, _), s in zip(data, sets)], key=str)
    assert root[20] == 1 == root[2] and root[21] == 3 == root[5]


def test_sketches_of_many_texts_at_once(monkeypatch):
    """Sets and signatures are those that each text has for itself, wherever the steps are cut."""
    from pagetide.llm.common import Words, shingles

    rng = random.Random(5)
    texts = [None, "one two", "", *(prose(rng, rng.choice((1, 3, 4, 5, 90)), 30) for _ in range(40)), " \n", "END end"]
    words = Words(texts, lower=True)
    items, first = minhash.distinct_shingles(words, 4)
    sets = [np.unique(shingles(words.of(i), 4)) for i in range(len(texts))]
    assert [s.tolist() for s in np.split(items, first[1:-1])] == [s.tolist() for s in sets]
    full = [s for s in sets if len(s)]
    bounds = np.cumsum([0, *map(len, full)])
    for step in (7, 64, 10_000):
        monkeypatch.setattr(minhash, "_STEP", step)
        got = minhash.signatures(np.concatenate(full), bounds)
        for row, own in zip(got, full):
            v = own[None, :] * minhash._MULTIPLY[:, None] + minhash._ADD[:, None]
            v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            assert (row == (np.stack([v.min(axis=1), v.max(axis=1)], axis=1).reshape(-1) >> np.uint64(32))).all()
            assert (minhash.band_keys(got)[0] == minhash.band_keys(got[0])).all()
