"""Order MinHash against its definition, in plain Python."""

from __future__ import annotations

import random
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from helpers import DOCS, prose, with_clashes
from pagetide.llm import ordered as O


def hashed(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_fingerprint(text):
    words = [hashed(w) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return [0] * O.M
    kmers = [tuple(words[i:i + O.K]) for i in range(max(1, len(words) - O.K + 1))]
    count, entries = Counter(), []
    for place, kmer in enumerate(kmers):
        kind = hashed(*kmer) >> 24
        entries.append((hashed(kind, count[kind]) >> 24, place))
        count[kind] += 1
    if len(entries) < O.L:
        return [hashed(entries[0][0] << 24)] * O.M
    out = []
    for start in O.STARTS:
        least = sorted(entries, key=lambda e: ((e[0] - (start >> 24)) % 2**40, e[1]))[:O.L]
        out.append(hashed(*[kind for kind, _ in sorted(least, key=lambda e: e[1])]))
    return out


TEXTS = ["", None, " \t\n", "one", "one two", "two one", "a b " * 40, "x " * 500, "Ü ñ  q", "a b c d e f g"]


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = TEXTS + [prose(rng, n, 30) for n in (3, 8, 40, 300, 2000)]
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), DOCS))
    got = {r.doc_id: r.fp for r in O.fingerprint(df, "text", "fp").collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_fingerprint(text), text


def test_order_and_edits_matter(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    blocks = [base[i:i + 2] for i in range(0, 300, 2)]
    rng.shuffle(blocks)
    texts = [base, base[:290] + ["new"] * 10, base[:150] + ["x"] + base[150:], [w for b in blocks for w in b], base[::-1]]
    fp = O.fingerprint(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS), "text", "fp")
    other = fp.select(F.col("fp").alias("first")).where("doc_id = 0")
    near = {r.doc_id: r.near for r in fp.crossJoin(other).select("doc_id", O.likeness("fp", "first").alias("near")).collect()}
    assert near[0] == 1.0 and near[1] > 0.8 and near[2] > 0.8
    assert near[3] < 0.5 and near[4] < 0.1  # the same words (and half of the pairs), in another order


def brute_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (hashed(r[1] or "") % 2**64) >> 34))
    out = []
    for i, (d, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        a, b, c = map(plain_fingerprint, (text, edited, after))
        share = lambda x, y: sum(p == q for p, q in zip(x, y)) / O.M
        out.append((d, len(text), edited, a, b, share(a, b), share(a, c)))
    return sorted(out, key=str)


def compare(df):
    return sorted(map(tuple, O.compare_edited(df).collect()), key=str)


def test_edited_texts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([i, i * 2**50, -i]), prose(rng, rng.randrange(60), 20)) for i in range(120)]
    rows += [(None, t) for t in TEXTS] + [(2**53 + 1, "a b c"), (2**53 + 3, "d é f"), (-2**63, "least"), (2**63 - 1, "most of all")]
    rows += [(7, prose(rng, 9, 20)) for _ in range(80)] + [(9, "the same row")] * 50  # hot identifiers
    df = with_clashes(spark.createDataFrame(rows, DOCS).repartition(6))
    assert compare(df) == brute_pairs(rows)


def test_small_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert compare(empty) == []
    for rows in ([(None, None)], [(5, "abcdef")], [(1, "abcdef"), (2, "uvwxyz")]):
        assert compare(spark.createDataFrame(rows, DOCS)) == brute_pairs(rows)
