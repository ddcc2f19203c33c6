"""Periodic runs of words: stretches that repeat one block again and again.

Every run has a root that is the longest Lyndon word at its place, under some order of the words
or under its reverse. The lengths of these longest Lyndon words (the Lyndon array) come straight
from the first phase of a grouping suffix sorter: suffixes are grouped by the Lyndon word they
begin with, groups are finished from the highest to the lowest, and a finished group is appended
to the factors before it. No suffix is sorted further. Equal roots that stand side by side are
then extended to both sides as far as the words one period apart are the same.

A word can only be in a run if the few words around it come again in its document, so stretches
without such repeats are skipped before the sorter; this loses no run.

Cases: a null or empty text has no words and no runs; very long texts are handled in time linear
in their words, by one task each; repeated rows are handled again; an empty table gives no rows;
further columns are passed through untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

RUNS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))


class _Groups:
    """Groups of places in the order of the words their factors spell, highest finished first."""

    def __init__(self, ranks: Sequence[int]):
        top = max(ranks) + 1
        self.of = [*ranks, -1]  # the entry behind the end also serves place -1; it is in no group
        self.members: list[list[int]] = [[] for _ in range(top)]
        for place, rank in enumerate(ranks):
            self.members[rank].append(place)
        self.length = [1] * top
        self.lower = list(range(-1, top - 1))
        self.higher = list(range(1, top + 1))
        self.top = top - 1

    def insert_above(self, group: int, length: int) -> int:
        """A new group between ``group`` and the one above it."""
        new, above = len(self.length), self.higher[group]
        self.length.append(length)
        self.members.append([])
        self.lower.append(group)
        self.higher.append(above)
        self.higher[group] = self.lower[above] = new
        return new


def lyndon_array(ranks: Sequence[int]) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon word at each place of ``ranks`` (dense, from 0), and a number
    that is the same for equal ones. What follows the end counts as smaller than every rank.

    The places not yet appended to an earlier one are the current factors, side by side. When the
    highest unfinished group is reached its factors cannot grow. Each row of k of them is appended
    to the factor before, which moves to a new group right above its old one, above the groups of
    smaller k. Every place is finished once and appended once, so the time is linear.
    """
    n = len(ranks)
    if n == 0:
        return [], []
    groups = _Groups(ranks)
    of, before = groups.of, list(range(-1, n))
    lengths, roots = [0] * n, [0] * n
    group = groups.top
    while group >= 0:
        size, grown = groups.length[group], []
        for place in groups.members[group]:
            if of[place] != group:
                continue  # moved to a higher group since
            lengths[place], roots[place] = size, group
            owner = before[place]
            if of[owner] == group:
                continue  # not the first of its row
            end = place + size
            while of[end] == group:
                end += size
            if end < n:
                before[end] = owner
            if owner >= 0:
                grown.append(((end - place) // size, owner))
        if len(grown) > 1:
            grown.sort(key=lambda g: -g[0])
        made: dict[tuple[int, int], int] = {}
        for times, owner in grown:
            old = of[owner]
            if (times, old) not in made:
                made[times, old] = groups.insert_above(old, groups.length[old] + times * size)
            of[owner] = made[times, old]
            groups.members[of[owner]].append(owner)
        groups.members[group] = []
        group = groups.lower[group]
    return lengths, roots


def _matches(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from places ``a`` and ``b`` on, rightwards (step 1) or leftwards (-1)."""
    room = len(words) - max(a, b) if step > 0 else min(a, b) + 1
    got, size = 0, 64
    while got < room:
        size = min(2 * size, room - got)
        at = step * np.arange(got, got + size)
        unlike = np.flatnonzero(words[a + at] != words[b + at])
        if len(unlike):
            return got + int(unlike[0])
        got += size
    return got


def _runs_of(words: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    ranks = np.unique(words, return_inverse=True)[1]
    found = set()
    for order in (ranks, int(ranks.max()) - ranks):
        lengths, roots = map(np.asarray, lyndon_array(order.tolist()))
        # a run of so many periods holds times - 1 whole roots side by side
        same = np.arange(len(words))
        for k in range(1, times - 1):
            next_ = same + k * lengths[same]
            same, next_ = same[next_ < len(words)], next_[next_ < len(words)]
            same = same[roots[same] == roots[next_]]
        held = np.zeros(len(words), dtype=bool)
        held[same] = True
        back = same - lengths[same]
        first = same[~((back >= 0) & held[back] & (roots[back] == roots[same]))]
        for place in first.tolist():
            period = int(lengths[place])
            left = _matches(words, place - 1, place - 1 + period, -1)
            length = left + period + _matches(words, place, place + period, 1)
            if length >= max(least, times * period):
                found.add((place - left, length, period))
    return found


def _window(least: int, times: int) -> int:
    """Most words so that those from every place of a run on, as far as they lie in it, come twice in it."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


def _repeated(words: np.ndarray, k: int) -> np.ndarray:
    """Marks the words inside runs of ``k`` words that come more than once. Sums that fall together
    by chance only mark more."""
    n = len(words)
    marked = np.zeros(n, dtype=bool)
    if n < k:
        return marked
    key = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[j:n - k + 1 + j].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    again = np.zeros(n - k + 1, dtype=bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    for j in range(k):
        marked[j:n - k + 1 + j] |= again
    return marked


def runs(words: Sequence, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least ``least`` words and ``times`` periods in a
    sequence of hashable words, by start, then period."""
    numbers: dict = {}
    ids = np.fromiter(map(numbers.setdefault, words, itertools.count()), dtype=np.int64, count=len(words))
    k = _window(least, times)
    marked = _repeated(ids, k) if k > 1 else np.ones(len(ids), dtype=bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]])))
    found = set()
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            found |= {(a + start, length, period) for start, length, period in _runs_of(ids[a:b], least, times)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def find(docs: DataFrame, least: int = 6, times: int = 4, text: str = "text", runs_: str = "runs",
         collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """``docs`` with the runs of its words, the text that keeps each run's first period only (kept
    words joined by one space), and the number of words. Words are separated by space and U+0009
    to U+000D. Columns of ``docs`` with the names of the new ones are replaced."""
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and two periods")
    passed = [c for c in docs.columns if c not in (runs_, collapsed, n_words)]
    schema = T.StructType([*docs.select(*[docs[c] for c in passed]).schema, T.StructField(runs_, RUNS),
                           T.StructField(collapsed, T.StringType()), T.StructField(n_words, T.LongType())])

    def run(batches):
        import pyarrow as pa

        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found, kept, counts = [], [], []
            for value in batch.column(passed.index(text)).to_pylist():
                words = (value or "").encode("utf-8").split()
                mine = runs(words, least, times)
                drop = np.zeros(len(words), dtype=bool)
                for start, length, period in mine:
                    drop[start + period:start + length] = True
                found.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                kept.append(b" ".join(itertools.compress(words, (~drop).tolist()) if mine else words).decode("utf-8"))
                counts.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, shape), pa.array(kept, pa.string()), pa.array(counts, pa.int64())],
                names=schema.names)

    return docs.select(*passed).mapInArrow(tidy(run), schema)
