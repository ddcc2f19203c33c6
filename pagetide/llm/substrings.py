"""Removal of passages that an earlier document has too, by seed and extend.

A window is ``WINDOW`` consecutive words. A word goes if a window over it also starts in a
document with a smaller identifier.

Seeds are winnowed: of the runs of ``SEED`` words in a window, the one with the smallest hash is
the window's anchor, so equal windows have equal anchors at equal places, and about one word in
twenty is an anchor. An anchor occurrence stands for its stretch: the windows in a row that have
it as their anchor. Documents are joined on anchors. Where all stretches of an anchor are alike,
the match extends over the whole stretch at once. Where they differ, each kind of stretch is
extended word by word to both sides, as the hashes of its windows, and these are joined. Runs of
matching windows merge into maximal repeats, always at least a window long.

Nothing is compared pairwise: every join is with the smallest identifier of an anchor, stretch
or window, found by an aggregation that combines before the shuffle. A passage shared by a third
of all documents costs each of them one row. Documents with equal word sequences are one class,
and only its first member is searched.

Cases: a null or empty text has no words; texts shorter than a window keep all words; of rows
that repeat an identifier none repeats the other, since neither's is smaller; a row without an
identifier matches nothing and keeps its words; an empty table gives no rows; other columns pass
through ``cut`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import Words, filtered, frames, in_pieces, key_filter, may_hold, signed, spread_join, tidy, windows

WINDOW = 50
SEED = 10


def stretches(words: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(anchor, stretch, first, last): hash of each anchor, hash of all words its windows cover,
    and its first and last window start, in text order. Ties go to the leftmost seed."""
    return all_stretches(words, np.array([0, len(words)]), window, seed)[1:]


def all_stretches(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, anchor, stretch, first, last): the stretches of each text ``words[bounds[i]:bounds[i + 1]]``,
    the starts counted from its first word."""
    size = np.diff(bounds)
    count = np.maximum(size - window + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    if not len(text):
        return text, text.astype(np.uint64), text.astype(np.uint64), text, text
    # the windows that lie in one text, by their place there and among all words
    place = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    start = place + bounds[text]
    low_bits = np.uint64((1 << 24) - 1)
    ahead = np.arange(len(words) - seed + 1, dtype=np.int64)
    hashes = windows(words, ahead, ahead + seed)
    places = (np.arange(len(words)) - np.repeat(bounds[:-1], size))[:len(hashes)].astype(np.uint64)
    low = (hashes & ~low_bits) | (places & low_bits)
    wide = window - seed + 1
    reach = 1
    while 2 * reach <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[:len(words) - window + 1], low[wide - reach:wide - reach + len(words) - window + 1])
    at = (low[start] & low_bits).astype(np.int64)
    at += (place >> 24) << 24
    at[at < place] += 1 << 24
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    whole = windows(words, start[first], start[last] + window) + (at[first] - place[first]).astype(np.uint64)
    return text[first], hashes[at[first] + bounds[text[first]]], whole, place[first], place[last]


def _sequence_identities(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the word sequence of each text; zeros without words."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((2, len(bounds) - 1), dtype=np.int64)
    out[0, full] = signed(windows(words, bounds[full], bounds[full + 1]))
    out[1, full] = signed(windows(words ^ (words >> np.uint64(7)), bounds[full], bounds[full + 1]))
    return out[0], out[1]


_SCAN = ("doc_id long, n_words long, seq_a long, seq_b long, "
         "anchor array<long>, stretch array<long>, first array<long>, last array<long>")


def scan(docs: DataFrame) -> DataFrame:
    """Word count, identity of the word sequence and anchor stretches of each row with an
    identifier."""
    def run(batches):
        for batch in batches:
            for frame in in_pieces(batch, "text"):
                words = Words(frame["text"].tolist())
                seq_a, seq_b = _sequence_identities(words.hashes, words.first)
                text, anchor, stretch, first, last = all_stretches(words.hashes, words.first)
                cuts = np.searchsorted(text, np.arange(1, len(frame)))
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].to_numpy(), "n_words": np.diff(words.first), "seq_a": seq_a, "seq_b": seq_b,
                    "anchor": np.split(signed(anchor), cuts), "stretch": np.split(signed(stretch), cuts),
                    "first": np.split(first, cuts), "last": np.split(last, cuts)})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(tidy(run), _SCAN)


def _window_rows(texts: DataFrame) -> DataFrame:
    """(anchor, window, doc_id, seq_a, at): hash of every window of the listed stretches."""
    def run(batches):
        for batch in batches:
            for frame in in_pieces(batch, "text"):
                words = Words(frame["text"].tolist())
                identity = _sequence_identities(words.hashes, words.first)[0]
                parts = []
                for i, row in enumerate(frame.itertuples(index=False)):
                    if identity[i] != row.seq_a:
                        continue  # another row with this identifier
                    first = np.asarray(row.first, dtype=np.int64)
                    count = np.asarray(row.last, dtype=np.int64) - first + 1
                    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    parts.append((np.repeat(np.asarray(row.anchor, dtype=np.int64), count),
                                  signed(windows(words.of(i), at, at + WINDOW)),
                                  np.full(len(at), row.doc_id), np.full(len(at), row.seq_a), at))
                if parts:
                    yield pd.DataFrame(dict(zip(("anchor", "window", "doc_id", "seq_a", "at"),
                                                map(np.concatenate, zip(*parts)))))

    return texts.mapInPandas(tidy(run), "anchor long, window long, doc_id long, seq_a long, at long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, seq_a, spans): word ranges [start, end) that go, for rows that lose any."""
    base = store(scan(docs), "anchors")
    same = ["seq_a", "seq_b", "n_words"]
    long_ones = base.where(F.col("n_words") >= WINDOW)
    classes = long_ones.groupBy(*same).agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("other")).where("source <> other").drop("other")
    whole = store(spread_join(long_ones.select("doc_id", *same), classes, same, "inner").where(
        "doc_id > source").select("doc_id", "seq_a", F.lit(0).cast("long").alias("start"),
                                  F.col("n_words").alias("end")).distinct(), "spans")

    # Copies are settled; the first member of each class is searched.
    seeds = long_ones.join(whole.select("doc_id", "seq_a"), ["doc_id", "seq_a"], "left_anti").select(
        "doc_id", "seq_a", F.inline(F.arrays_zip("anchor", "stretch", "first", "last")))
    # An anchor matters if two documents have it.
    anchors = seeds.groupBy("anchor").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("other"),
        F.min("stretch").alias("s1"), F.max("stretch").alias("s2")).where("source <> other")
    met = store(spread_join(seeds, anchors.select("anchor", "source", (F.col("s1") == F.col("s2")).alias("alike")),
                            ["anchor"], "inner"), "matches")
    span = ["doc_id", "seq_a", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end")]
    alike = met.where("alike and doc_id > source").select(*span)

    # Where stretches differ: equal ones follow their first, and the firsts are extended.
    unlike = met.where("not alike").drop("source", "alike")
    kinds = unlike.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("source"))
    unlike = store(spread_join(unlike, kinds, ["anchor", "stretch"], "inner"), "stretches")
    follow = unlike.where("doc_id > source").select(*span)
    leads = store(unlike.where("doc_id = source").groupBy("doc_id", "seq_a").agg(
        F.collect_list(F.struct("anchor", "first", "last")).alias("s")).select(
        "doc_id", "seq_a", F.col("s.anchor").alias("anchor"), F.col("s.first").alias("first"),
        F.col("s.last").alias("last")), "leads")
    texts = store(filtered(docs.select("doc_id", "text"), leads, "doc_id").join(leads, "doc_id"), "texts")
    rows = store(_window_rows(texts), "windows")
    seen = rows.groupBy("anchor", "window").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("other")).where(
        "source <> other").drop("other")
    extended = spread_join(rows, seen, ["anchor", "window"], "inner").where("doc_id > source").select(
        "doc_id", "seq_a", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end"))
    return whole.union(alike).union(follow).union(extended).groupBy("doc_id", "seq_a").agg(
        F.collect_list(F.struct("start", "end")).alias("s")).select(
        "doc_id", "seq_a", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def kept_words(word_count: int, starts, ends) -> np.ndarray:
    """Which words stay."""
    edge = np.zeros(word_count + 1, dtype=np.int64)
    np.add.at(edge, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(edge, np.asarray(ends, dtype=np.int64), -1)
    return np.cumsum(edge[:-1]) == 0


def cut(docs: DataFrame, found: DataFrame, n_words: str = "n_words", n_removed: str = "n_removed",
        text: str = "kept") -> DataFrame:
    """``docs`` with its word count, the number of words that ``found`` (see ``repeats``) removes,
    and the kept words joined by single spaces.

    Documents that lose nothing do not move; only those that may be in ``found`` are joined.
    """
    names = (n_words, n_removed, text)
    table, add = docs.sparkSession.sparkContext.broadcast(key_filter(found, "doc_id")), _cutter(docs, names)

    def plain(batches):
        for batch in batches:
            known = batch["doc_id"].notna().to_numpy()
            listed = np.zeros(len(batch), dtype=bool)
            listed[known] = may_hold(table.value, batch["doc_id"][known].to_numpy(dtype=np.int64))
            yield from add([batch[~listed]])

    return cut_listed(docs, found, *names).union(frames(docs, plain, _cut_schema(docs, names)))


def cut_listed(docs: DataFrame, found: DataFrame, n_words: str = "n_words", n_removed: str = "n_removed",
               text: str = "kept") -> DataFrame:
    """The rows of ``cut`` that may be in ``found``: all that lose words are among them. The others are
    what ``filtered`` leaves with ``keep=False``."""
    names = (n_words, n_removed, text)
    spans = found.groupBy(F.col("doc_id").alias("_doc_id")).agg(
        F.collect_list(F.struct("seq_a", "start", "end")).alias("_spans"))
    # written between, so that a task has one Python worker at a time
    joined = store(filtered(docs, found, "doc_id").join(spans, F.col("doc_id") == F.col("_doc_id"), "left").drop("_doc_id"), "touched")
    return frames(joined, _cutter(docs, names), _cut_schema(docs, names))


def _cut_schema(docs: DataFrame, names: tuple[str, str, str]) -> T.StructType:
    kinds = (T.LongType(), T.LongType(), T.StringType())
    return T.StructType([*docs.schema.fields, *(T.StructField(n, kind) for n, kind in zip(names, kinds))])


def _cutter(docs: DataFrame, names: tuple[str, str, str]) -> Callable:
    """Adds the columns ``names`` of ``cut`` to frames; without ``_spans`` no word goes."""
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for frame in in_pieces(batch, "text"):
                texts, sizes, gone, kept = frame["text"].tolist(), [], [], []
                spans = frame["_spans"] if "_spans" in frame else [None] * len(frame)
                words = Words(texts) if "_spans" in frame else None
                identity = _sequence_identities(words.hashes, words.first)[0] if words else None
                for i, (each, own) in enumerate(zip(texts, spans)):
                    # bytes are split at the separators of words
                    parts = each.encode("utf-8").split() if each else []
                    sizes.append(len(parts))
                    for one in own if own is not None else ():
                        if one["seq_a"] == identity[i]:
                            stay = kept_words(len(parts), one["start"], one["end"])
                            parts = [p for p, s in zip(parts, stay) if s]
                    gone.append(sizes[-1] - len(parts))
                    kept.append(b" ".join(parts).decode("utf-8"))
                yield frame[columns].assign(**dict(zip(names, (sizes, gone, kept))))

    return run
