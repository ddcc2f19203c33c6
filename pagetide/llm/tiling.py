"""Benchmark decontamination by greedy string tiling.

A benchmark item counts as leaked into a document if tiles, i.e. non-overlapping runs of at
least ``SHORTEST`` equal words, cover enough of the item, in whatever order they occur there; so
passages whose sentences were moved are caught as well.

Words are case-folded runs of letters and digits. Documents are first read for runs of words
that are seeds (word 5-grams) of some item, by a bit table of fixed size; only those runs go on,
with the seeds found in them. Documents and items are joined on seeds, pairs whose shared seeds cannot cover enough are
dropped (tiles consist of seeds, so this loses none), and the rest are tiled: the longest match
of unmarked words, found by running Karp-Rabin hashes, is marked, again and again, with
shrinking lengths.

Cases: null and empty texts have no words; an item with fewer words than a seed is matched as
one whole, its own length being the shortest tile; a document without an identifier is reported
as clean; items without an identifier are used and reported as item null; of rows that repeat an
identifier all leak if one does; empty tables leave all documents clean; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import (Words, folded, frames, in_pieces, key_filter, may_hold, runs_of, shingles, signed, spread_join, tidy, whole,
                     width, windows)

SHORTEST = 5
COVERAGE = 0.6

# Base of the rolling hash; arithmetic is modulo 2**64.
_BASE = np.uint64(0x5851F42D4C957F2D)


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words): hashed words of each item with any; ``item`` tells rows apart."""
    def run(batches):
        for batch in batches:
            words = Words(folded(batch["text"]))
            rows = [(int(signed(shingles(words.of(i), len(words.of(i)) or 1)[:1])[0]), item_id, signed(words.of(i)))
                    for i, item_id in enumerate(batch["item_id"]) if len(words.of(i))]
            yield pd.DataFrame({"item": [r[0] for r in rows], "item_id": whole([r[1] for r in rows]), "words": [r[2] for r in rows]})

    return frames(items.select("item_id", "text"), run, "item long, item_id long, words array<long>").groupBy(
        "item").agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"))


def _seeds_of(words) -> np.ndarray:
    return signed(shingles(np.asarray(words, dtype=np.int64).view(np.uint64), SHORTEST))


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, at) for every seed; an item shorter than a seed has one, of all its words."""
    def run(batches):
        for batch in batches:
            for item, words in zip(batch["item"], batch["words"]):
                seeds = _seeds_of(words)
                yield pd.DataFrame({"seed": seeds, "item": item, "at": np.arange(len(seeds)), "n": len(words)})

    return items.mapInPandas(tidy(run), "seed long, item long, at long, n long")


def suspects(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, runs, seeds, row): of each document that may hold seeds, the runs of words made of
    them, and the seeds. Equal documents are one row."""
    table = docs.sparkSession.sparkContext.broadcast(
        (key_filter(seeds, "seed"), sorted(r["n"] for r in seeds.where(F.col("n") < SHORTEST).select("n")
                                           .distinct().collect())))  # at most SHORTEST - 1 numbers

    def run(batches):
        bits, short = table.value
        for batch in batches:
            for frame in in_pieces(batch, "text"):
                words = Words(folded(frame["text"]))
                ids, runs, held = frame["doc_id"].tolist(), {}, {}
                inside = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                for n in (*short, SHORTEST):
                    text, start, end = runs_of(words, n)
                    seed = signed(windows(words.hashes, start, end))
                    hit = may_hold(bits, seed) & (end - start == n)
                    inside[start[hit]] += 1
                    inside[end[hit]] -= 1
                    for i, value in zip(text[hit].tolist(), seed[hit].tolist()):
                        held.setdefault(i, set()).add(value)
                covered = np.append(np.cumsum(inside[:-1]) > 0, False)
                # a run ends with its text, also where the next text begins with one
                first = np.isin(np.arange(len(covered)), words.first)
                opens = np.flatnonzero(covered & (first | ~np.roll(covered, 1)))
                closes = np.flatnonzero(np.roll(covered, 1) & (first | ~covered))
                of = np.searchsorted(words.first, opens, side="right") - 1
                for i, a, b in zip(of.tolist(), opens, closes):
                    runs.setdefault(i, []).append(signed(words.hashes[a:b]).tolist())
                if runs:
                    yield pd.DataFrame({"doc_id": whole([ids[i] for i in runs]), "runs": list(runs.values()),
                                        "seeds": [list(held[i]) for i in runs]})

    found = frames(docs.select("doc_id", "text"), run, "doc_id long, runs array<array<long>>, seeds array<long>")
    return found.withColumn("row", F.xxhash64("runs"))


def tiles(left: np.ndarray, right: np.ndarray, shortest: int = SHORTEST) -> Iterator[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in left, start in right, length).

    Lengths shrink from the longest possible; at each, unmarked runs of that length in ``right``
    are looked up by rolling hash among those of ``left``, compared, extended and marked.
    """
    free_left, free_right = np.ones(len(left), bool), np.ones(len(right), bool)
    length = min(len(left), len(right))
    while length >= shortest:
        places: dict[int, list[int]] = {}
        for at, value in _rolling(left, free_left, length):
            places.setdefault(value, []).append(at)
        longest = 0
        for b, value in _rolling(right, free_right, length) if places else ():
            for a in places.get(value, ()):
                if (free_left[a:a + length].all() and free_right[b:b + length].all()
                        and (left[a:a + length] == right[b:b + length]).all()):
                    free_left[a:a + length] = False
                    free_right[b:b + length] = False
                    longest = length
                    yield a, b, length
                    break
        if longest == 0 and length > 2 * shortest:
            # No match of this length: none is longer than the longest common run.
            length = min(length - 1, _longest_run(left, right, free_left, free_right))
        else:
            length -= 1


def _rolling(words: np.ndarray, free: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Start and hash of each run of ``length`` unmarked words."""
    if length > len(words):
        return
    base, value = int(_BASE), 0
    top = pow(base, length - 1, 2**64)
    run = 0
    for i, word in enumerate(words.tolist()):
        run = run + 1 if free[i] else 0
        if i >= length:
            value -= words[i - length].item() * top
        value = (value * base + word) % 2**64
        if run >= length:
            yield i - length + 1, value


def _longest_run(left, right, free_left, free_right) -> int:
    """Length of the longest run that both have among their unmarked words."""
    best = 0
    previous = np.zeros(len(left) + 1, dtype=np.int64)
    for word, free in zip(right, free_right):
        current = np.zeros_like(previous)
        if free:
            current[1:] = np.where((left == word) & free_left, previous[:-1] + 1, 0)
            best = max(best, int(current.max()))
        previous = current
    return best


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(row, doc_id, item_id, covered, n_tiles) of the most covered item, for leaking documents."""
    known = store(item_words(items), "items")
    seeds = store(item_seeds(known), "seeds")
    found = store(suspects(docs, seeds), "suspects")
    # the runs settle the seeds
    bodies = found.groupBy("row").agg(F.first("runs").alias("runs"), F.first("seeds").alias("seeds"))
    met = bodies.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
    covers = F.flatten(F.collect_set(F.sequence(F.col("at"), F.least(F.col("at") + SHORTEST, F.col("n")) - 1)))
    pairs = met.groupBy("row", "item", "n").agg(F.size(F.array_distinct(covers)).alias("most")).where(
        F.col("most") >= F.col("n") * coverage).select("row", "item")

    def judge(batches):
        for batch in batches:
            out = []
            for row, item_id, runs, words in zip(batch["row"], batch["item_id"], batch["runs"], batch["words"]):
                item = np.asarray(words, dtype=np.int64)
                # Runs follow each other with a value between that no item has.
                gap = np.int64(item.max() - 1 if item.max() > np.iinfo(np.int64).min else 0)
                while (item == gap).any():
                    gap -= 1
                text = np.concatenate([np.append(np.asarray(r, dtype=np.int64), gap) for r in runs])
                lengths = [n for _, _, n in tiles(text, item, min(SHORTEST, len(item)))]
                out.append((row, item_id, sum(lengths) / len(item), len(lengths)))
            yield pd.DataFrame(out, columns=["row", "item_id", "covered", "n_tiles"], dtype=object)

    # judging is bound by work, not bytes: all cores take part
    spread = pairs.join(bodies.drop("seeds"), "row").join(known, "item").repartition(width(docs.sparkSession))
    judged = frames(spread, judge, "row long, item_id long, covered double, n_tiles long").where(
        F.col("covered") >= coverage)
    best = judged.groupBy("row").agg(F.max_by(F.struct("item_id", "covered", "n_tiles"),
                                              F.struct("covered", -F.col("item_id"))).alias("b")).select(
        "row", "b.*")
    return spread_join(found.select("row", "doc_id"), best, ["row"], "inner")


def flagged(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, contaminated, item_id, covered, n_tiles) for every row of ``docs``."""
    hits = store(leaks(docs, items, coverage), "leaks")
    worst = hits.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(
        F.struct("item_id", "covered", "n_tiles"), F.struct("covered", -F.col("item_id"))).alias("b")).select(
        "doc_id", "b.*")
    return docs.select("doc_id").join(worst, "doc_id", "left").select(
        "doc_id", F.col("covered").isNotNull().alias("contaminated"), "item_id",
        F.coalesce("covered", F.lit(0.0)).alias("covered"), F.coalesce("n_tiles", F.lit(0).cast("long")).alias("n_tiles"))
