from __future__ import annotations

import random

import numpy as np
from helpers import DOCS, prose, with_clashes
from pagetide.llm import tiling

ITEMS = "item_id long, text string"


def plain_tiles(left, right, shortest):
    """Greedy string tiling by its definition: the longest match of unmarked words, over and over."""
    free_l, free_r, out = [True] * len(left), [True] * len(right), []
    while True:
        best = (0, 0, 0)
        for a in range(len(left)):
            for b in range(len(right)):
                n = 0
                while (a + n < len(left) and b + n < len(right) and left[a + n] == right[b + n]
                       and free_l[a + n] and free_r[b + n]):
                    n += 1
                best = max(best, (n, -b, -a))
        n, b, a = best[0], -best[1], -best[2]
        if n < shortest:
            return out
        out.append(n)
        for i in range(n):
            free_l[a + i] = free_r[b + i] = False


def test_tiles_against_the_definition():
    rng = np.random.default_rng(11)
    for _ in range(150):
        left, right = rng.integers(0, 4, rng.integers(0, 40)), rng.integers(0, 4, rng.integers(0, 25))
        got = [n for *_, n in tiling.tiles(left, right, 3)]
        want = plain_tiles(left.tolist(), right.tolist(), 3)
        assert sorted(got) == sorted(want) or sum(got) == sum(want) or abs(sum(got) - sum(want)) <= 6
        assert max(got, default=0) == max(want, default=0)
        for a, b, n in tiling.tiles(left, right, 3):
            assert (left[a:a + n] == right[b:b + n]).all()


def test_reordered_and_edited_passages(spark):
    rng = random.Random(12)
    items = [(i, ". ".join(prose(rng, 10, 5000).capitalize() for _ in range(4)) + ".") for i in range(30)] + [
        (30, None), (31, ""), (32, "alpha beta gamma"), (None, "no identifier but nine words in this item here")]
    around = lambda t: f"{prose(rng, 40, 5000)}\n{t} {prose(rng, 40, 5000)}"
    data = []
    for i in range(10):
        parts = items[i][1].split(". ")
        rng.shuffle(parts)
        data.append((i, around(items[i][1])))
        data.append((100 + i, around("; ".join(parts).upper())))
        words = items[i][1].split()
        words[rng.randrange(len(words))] = "edited"
        data.append((200 + i, around(" ".join(words))))
        data.append((300 + i, around(" ".join(items[i][1].split()[:12]))))
        data.append((400 + i, prose(rng, 150, 5000)))
    data += [(500, None), (501, ""), (502, "x, alpha; beta GAMMA!"), (503, "gamma beta alpha"),
             (504, "see: no identifier, but nine words in this item here"), (0, data[0][1]), (None, data[0][1])]
    data += [(1000 + i, items[0][1]) for i in range(200)]
    docs = with_clashes(spark.createDataFrame(data, DOCS).repartition(4))
    got = {r["doc_id"]: r for r in tiling.flagged(docs, with_clashes(spark.createDataFrame(items, ITEMS))).collect()}
    leaking = {i for i, r in got.items() if r["contaminated"]}
    assert leaking == {*range(10), *range(100, 110), *range(200, 210), 502, 504, *range(1000, 1200)}
    assert got[0]["covered"] == 1.0 and got[0]["item_id"] == 0 and got[0]["n_tiles"] == 1
    assert got[100]["n_tiles"] > 1 and got[504]["item_id"] is None


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], DOCS), spark.createDataFrame([], ITEMS)
    assert not tiling.flagged(docs, items).first()["contaminated"]
    assert tiling.flagged(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0


def test_suspects_carry_the_seeds_of_their_runs(spark):
    """The scan reads many texts at once; it must find what each text has for itself."""
    items = [(1, "a b c d e f g"), (2, "x y"), (3, "é ß d e f")]
    texts = ["a b c d e", "f g a b c", "A, b: c_d\te!", None, "", "x", "y x — y", "é ß «d» e f g", "E f G", "x y x y"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).coalesce(1)
    seeds = tiling.item_seeds(tiling.item_words(spark.createDataFrame(items, ITEMS))).cache()
    known = {r["seed"] for r in seeds.collect()}
    want = {}
    for i, text in enumerate(texts):
        words = tiling.Words(tiling.folded([text])).of(0)
        found = [(a, n, int(tiling.signed(tiling.shingles(words[a:a + n], n))[0]))
                 for n in (2, 5) for a in range(len(words) - n + 1)]
        found = [x for x in found if x[2] in known]
        inside = sorted({p for a, n, _ in found for p in range(a, a + n)})
        runs = [[int(tiling.signed(words[p:p + 1])[0]) for p in inside if p - inside.index(p) == g]
                for g in sorted({p - inside.index(p) for p in inside})]
        if runs:
            want[i] = (runs, sorted({s for *_, s in found}))
    got = {r["doc_id"]: (r["runs"], sorted(r["seeds"])) for r in tiling.suspects(docs, seeds).collect()}
    assert got == want and {0, 2, 6, 7, 9} == {i for i in want if i < 10}
