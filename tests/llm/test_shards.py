from __future__ import annotations

import random
import zlib

from helpers import DOCS, with_clashes
from pagetide.llm import shards


def test_sizes_positions_and_versions(spark):
    rng = random.Random(1)
    data = [(i, "é" * rng.randrange(0, 900)) for i in range(3000)] + [(5000, None), (5001, "")] + [(7, "x")] * 3 + [
        (None, "y"), (None, None)]
    got = shards.assign(with_clashes(spark.createDataFrame(data, DOCS))).collect()
    assert len(got) == len(data)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in data)
    load = [0] * shards.SHARDS
    places = {}
    for r in got:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["position"])
        assert r["map_version"] == 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load) - min(load) <= 0.01 * max(load)


def test_one_large_document_leaves_the_rest_even(spark):
    data = [(0, "x" * 100_000)] + [(i, "y" * 99) for i in range(1, 1500)]
    load = [0] * shards.SHARDS
    for r in shards.assign(spark.createDataFrame(data, DOCS)).collect():
        load[r["shard"]] += r["size"]
    rest = sorted(load)[:-1]
    assert 100_001 <= max(load) <= 100_001 + 500 and rest[-1] - rest[0] <= 200


def test_edit_moves_little_when_a_shard_is_added():
    rng = random.Random(2)
    size = {s: rng.randrange(50, 150) for s in range(4096)}
    old = shards.edit_map(shards.first_map(4096, 16), size, 16)
    new = shards.edit_map(old, size, 17)
    moved = sum(size[s] for s in range(4096) if old[s] != new[s])
    assert moved <= sum(size.values()) / 17 * 1.1
    load = [0] * 17
    for s, shard in enumerate(new):
        load[shard] += size[s]
    assert max(load) - min(load) <= 0.01 * max(load)


def test_empty_table(spark):
    assert shards.assign(spark.createDataFrame([], DOCS)).count() == 0
