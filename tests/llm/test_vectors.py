from __future__ import annotations

import math

import numpy as np
from helpers import roots, with_clashes
from pagetide.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(data):
    ok = [(i, np.array(e, dtype=np.float32).astype(float), c) for i, e, c in data
          if c is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = [(a[0], b[0]) for i, a in enumerate(ok) for b in ok[:i] if a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= vectors.COSINE]
    root = roots([i for i, *_ in data], links)
    count = {i: 0 for i, *_ in data}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], root[i]) for i, *_ in data}


def make(rng):
    data = []
    for group in range(60):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 8)):
            data.append((len(data), (base + rng.standard_normal(32) * rng.uniform(0.05, 0.45)).tolist(), int(group % 3)))
    hot = rng.standard_normal(32)
    for _ in range(150):
        data.append((len(data), (hot + rng.standard_normal(32) * 0.3).tolist(), 1))
    for _ in range(40):
        data.append((len(data), data[5][1], data[5][2]))
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None] * 16, [float("inf")] + [0.0] * 31, [1.0] * 8]
    for e in bad:
        data.append((len(data), e, 1))
    data.append((len(data), data[0][1], None))
    return data


def test_against_brute_force(spark, monkeypatch):
    data = make(np.random.default_rng(5))
    # Small blocks, so that buckets are cut and several bits are used.
    monkeypatch.setattr(vectors, "BLOCK", 32)
    got = vectors.near_vectors(with_clashes(spark.createDataFrame(data, SCHEMA))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == expected(data)


def test_repeats_missing_identifiers_and_empty(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    got = vectors.near_vectors(spark.createDataFrame([(1, v, 0), (1, v, 0), (2, w, 0), (None, w, 0), (None, None, 0)], SCHEMA))
    assert sorted(map(str, got.select("vec_id", "n_links", "component_id").collect())) == sorted(map(str, (
        spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 2), (None, 1, 2), (None, 0, None)],
                              "vec_id long, n_links long, component_id long").collect())))
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((400, 64))
    b = a + rng.standard_normal((400, 64)) * 0.35
    errors = []
    for seed in range(40):
        turn = vectors.rotation(64, seed)
        _, signs, factor = vectors.encode(a, turn)
        turned, _, _ = vectors.encode(b, turn)
        cosine = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
        estimate = np.diag(vectors.estimates(signs, factor, turned))
        errors.append(estimate - cosine)
        near = cosine >= vectors.COSINE
        assert (estimate[near] >= vectors.least_estimate(factor, 64, vectors.COSINE)[near]).all()
    assert abs(np.mean(errors)) < 0.002


def test_bands_find_pairs_at_the_similarity():
    rng = np.random.default_rng(7)
    for n in (10_000, 1_000_000):
        bits, bands = vectors.band_plan(n, 64)
        a = rng.standard_normal((4000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side = rng.standard_normal((4000, 64))
        side -= (side * a).sum(1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        b = vectors.COSINE * a + math.sqrt(1 - vectors.COSINE ** 2) * side
        met = (vectors.band_bits(a, bits, bands) == vectors.band_bits(b, bits, bands)).any(axis=1)
        assert met.mean() >= 0.999
