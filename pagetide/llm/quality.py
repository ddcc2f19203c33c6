"""Document quality by Bradley-Terry ranking.

A document's score is a weighted sum of its features. Weights are learned from preference pairs,
a good and a bad document each: the probability that the good one wins is the logistic function
of the difference of their scores, so the loss is logistic loss on feature differences, without
an intercept. The threshold is the quantile of the training scores at the share of bad
documents; scores are mapped to 0..1 by a logistic curve that passes ``CUT`` there.

Features are shares and rates of the whole text, so that length alone says little. Training
takes every labelled document. They are dealt to pieces of about ``PIECE_ROWS`` by a hash, each
with documents of both kinds, and pairs are formed inside a piece. Medians, deviations, quantiles
and the steps of Newton's method come from sums and counts over all pieces; what reaches the
driver does not grow with the table.

Cases: a null or empty text has the features of an empty one; labels without identifier, value
or document are left out, and of repeated ones the lowest counts; with labels of one kind only,
or none, all documents score 1 (only good or none) or 0; repeated rows are scored alike; a row
without an identifier is not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, store
from .common import frames
from .linear import sigmoid

PIECE_ROWS = 4_096
# Of the rarer kind, a piece gets at least about so many.
RARER = 50
# Pairs of each document of the commoner kind.
PAIRINGS = 8
BINS = 256
CUT = 0.7
RIDGE = 1e-3
# Steepness of the score curve, in standard deviations of the training scores.
STEEPNESS = 6.0

FEATURES = (
    "letters", "capitals", "digits", "spaces", "marks", "symbols", "pipes", "exclamations", "other_bytes",
    "word_length", "long_words", "short_words", "distinct_words", "top_word", "word_repeats", "ends_in_symbol",
    "capital_words", "line_length", "sentence_ends", "distinct_lines", "size",
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@\\^_`{}~/"]
_MARKS = [ord(c) for c in ".,;:?'\"()-"]


def features_of(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = (text or "").split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    seen = Counter(words)
    lines = (text or "").split("\n")
    ends = Counter(w[-1] for w in words)
    stops = sum(ends[c] for c in ".!?")
    return np.array([
        count[_LETTER].sum() / n, count[65:91].sum() / n, count[48:58].sum() / n, count[[32, 10]].sum() / n,
        count[_MARKS].sum() / n, count[_SYMBOLS].sum() / n, count[124] / n, count[33] / n, count[:32].sum() / n,
        min(lengths.mean(), 20.0) / 10 if len(words) else 0.0, (lengths > 14).sum() / m, (lengths < 3).sum() / m,
        len(seen) / m, max(seen.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(v for c, v in ends.items() if not c.isalnum() and c not in ".,;:?!)\"'") / m,
        sum(map(str.isupper, words)) / m, min(np.log1p(n / len(lines)), 8.0) / 8,
        min(stops / m, 1.0), len(set(lines)) / len(lines), min(np.log1p(n), 12.0) / 12,
    ])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Ranking:
    """Score of a document, and the curve to 0..1."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Beyond four deviations a feature says no more.
        return np.clip((x - self.centre) / self.scale, -4, 4) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(STEEPNESS * (self.raw(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT)))


def preference_pairs(y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (good, bad): every document of the rarer kind meets about equally many of the other."""
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    n = PAIRINGS * max(len(good), len(bad))
    rng = np.random.default_rng([6, seed])
    take = lambda of: rng.permutation(np.resize(of, n))
    return take(good), take(bad)


def _pieces(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(piece, x, y, own): the labelled rows of a piece in a fixed order, as packed numbers. Rows of
    the rarer kind go to several pieces if there are too few; ``own`` marks the first copy of each."""
    n = -(-(good + bad) // PIECE_ROWS)
    copies = min(n, max(1, -(-RARER * n // min(good, bad))))
    rare = (F.col("quality") > 0) if good <= bad else (F.col("quality") <= 0)
    copy = F.explode(F.sequence(F.lit(0), F.when(rare, copies - 1).otherwise(0)))
    further = F.when(F.lit(copies == n) | (F.col("copy") == 0), F.col("copy")).otherwise(
        F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n)))
    spread = F.pmod(F.pmod(F.xxhash64("doc_id", "x"), F.lit(n)) + further, F.lit(n))
    dealt = rows.withColumn("copy", copy).withColumn("piece", spread)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["x"].to_list())
        order = np.lexsort((frame["copy"].to_numpy(), *x.T[::-1], frame["doc_id"].to_numpy()))
        y, own = (frame["quality"].to_numpy() > 0)[order], (frame["copy"].to_numpy() == 0)[order]
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "x": [x[order].tobytes()], "y": [y.tobytes()], "own": [own.tobytes()]})

    return dealt.groupBy("piece").applyInPandas(pack, "piece long, x binary, y binary, own binary")


def _unpacked(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for piece, x, y, own in zip(batch["piece"], batch["x"], batch["y"], batch["own"]):
            yield piece, np.frombuffer(x).reshape(-1, len(FEATURES)), np.frombuffer(y, dtype=bool), np.frombuffer(own, dtype=bool)


def _summed(pieces: DataFrame, rule: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all pieces of ``rule(piece, x, y, own)``, always added in the same order."""
    def run(batches):
        for piece, x, y, own in _unpacked(batches):
            yield pd.DataFrame({"piece": [piece], "v": [rule(piece, x, y, own)]})

    parts = pieces.mapInPandas(run, "piece long, v array<double>").select("piece", F.posexplode("v").alias("at", "v"))
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("piece", "v"))), F.lit(0.0), lambda a, p: a + p["v"])
    return np.array([r["v"] for r in sorted(parts.groupBy("at").agg(added.alias("v")).collect())])


def _ranked(pieces: DataFrame, values: Callable[[np.ndarray], np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """For each column of ``values(x)`` over all rows its value at place ``ranks`` (from 0) in order:
    histograms narrow the span around it, round by round, until one value is left."""
    columns = len(ranks)
    low, high, below = np.full(columns, -np.inf), np.full(columns, np.inf), np.zeros(columns, dtype=np.int64)
    while (low < high).any():
        def run(batches, low=low, high=high):
            n = np.zeros((columns, BINS), dtype=np.int64)
            least, most = np.full((columns, BINS), np.inf), np.full((columns, BINS), -np.inf)
            for _, x, _, own in _unpacked(batches):
                held = values(x[own])
                for k in range(columns):
                    v = np.sort(held[(held[:, k] >= low[k]) & (held[:, k] <= high[k]), k])
                    span = high[k] - low[k]
                    at = np.minimum((v - low[k]) / span * BINS, BINS - 1).astype(np.int64) if 0 < span < np.inf else np.zeros(len(v), dtype=np.int64)
                    bins, first, count = np.unique(at, return_index=True, return_counts=True)
                    n[k, bins] += count
                    least[k, bins] = np.minimum(least[k, bins], v[first])
                    most[k, bins] = np.maximum(most[k, bins], v[first + count - 1])
            k, bins = np.nonzero(n)
            yield pd.DataFrame({"k": k, "bin": bins, "n": n[k, bins], "low": least[k, bins], "high": most[k, bins]})

        found = pieces.mapInPandas(run, "k int, bin int, n long, low double, high double").groupBy("k", "bin").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("k", "bin").collect()
        low, high, seen, done = low.copy(), high.copy(), below.copy(), np.zeros(columns, dtype=bool)
        for r in found:
            k = r["k"]
            if not done[k] and seen[k] + r["n"] > ranks[k]:
                low[k], high[k], below[k], done[k] = r["low"], r["high"], seen[k], True
            seen[k] += r["n"]
    return low


def _newton(pieces: DataFrame, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights that minimise the mean logistic loss of all pairs plus ``RIDGE`` / 2 times their
    squared length; a step that would raise it is halved."""
    k = len(FEATURES)
    upper = np.triu_indices(k)

    def measured(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def rule(piece, x, y, own):
            z = np.clip((x - centre) / scale, -4, 4)
            good, bad = preference_pairs(y, piece)
            d = z[good] - z[bad]
            ahead = d @ w
            lost = sigmoid(-ahead)
            curve = (d * (lost * (1 - lost))[:, None]).T @ d
            return np.concatenate([[len(d), np.logaddexp(0, -ahead).sum()], -lost @ d, curve[upper]])

        sums = _summed(pieces, rule)
        mean = sums[1:] / max(1.0, sums[0])
        curve = np.zeros((k, k))
        curve[upper] = mean[1 + k:]
        curve = curve + np.triu(curve, 1).T + RIDGE * np.eye(k)
        return mean[0] + RIDGE / 2 * w @ w, mean[1:1 + k] + RIDGE * w, curve

    w = np.zeros(k)
    loss, slope, curve = measured(w)
    step = -np.linalg.solve(curve, slope)
    for _ in range(60):
        trial = measured(w + step)
        if trial[0] > loss + 1e-12:
            step = step / 2
        else:
            w, (loss, slope, curve) = w + step, trial
            step = -np.linalg.solve(curve, slope)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _moments(pieces: DataFrame, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Standard deviation of each column of ``values(x)`` over all rows."""
    def rule(about):
        return lambda piece, x, y, own: np.concatenate([[own.sum()], ((values(x[own]) - about[0]) ** about[1]).sum(axis=0)])

    first = _summed(pieces, rule((0.0, 1)))
    second = _summed(pieces, rule((first[1:] / first[0], 2)))
    return np.sqrt(second[1:] / second[0])


def fit_ranking(pieces: DataFrame, good: int, bad: int) -> Ranking:
    """The ranking of all labelled rows, of which ``good`` and ``bad`` there are so many."""
    n, k = good + bad, len(FEATURES)
    middle = _ranked(pieces, lambda x: np.concatenate([x, x], axis=1), np.repeat([(n - 1) // 2, n // 2], k))
    centre = (middle[:k] + middle[k:]) / 2
    scale = np.maximum(_moments(pieces, lambda x: x), 1e-3)
    w = _newton(pieces, centre, scale)

    def raw(x: np.ndarray) -> np.ndarray:
        return (np.clip((x - centre) / scale, -4, 4) @ w)[:, None]

    share = bad / n
    places = np.clip([share - 0.005, share + 0.005], 0.0, 1.0) * (n - 1)
    floor = np.floor(places).astype(np.int64)
    at = _ranked(pieces, lambda x: np.repeat(raw(x), 4, axis=1), np.concatenate([floor, np.minimum(floor + 1, n - 1)]))
    ends = at[:2] + (at[2:] - at[:2]) * (places - floor)
    return Ranking(centre, scale, w, float(ends.mean()), float(max(_moments(pieces, raw)[0], 1e-9)))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [features_of(t) for t in batch["text"]]})

    return frames(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


def train_measured(features: DataFrame, labels: DataFrame) -> Ranking:
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.min("quality").alias("quality"))
    rows = store(features.join(known, "doc_id").select("doc_id", "quality", "x"), "labelled")
    good, n = rows.agg(F.count_if(F.col("quality") > 0), F.count(F.lit(1))).first()
    if good == n or good == 0:
        discard(rows)
        k = len(FEATURES)
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), -np.inf if good == n else np.inf, 1.0)
    pieces = store(_pieces(rows, good, n - good), "pieces")
    ranking = fit_ranking(pieces, good, n - good)
    discard(pieces)
    discard(rows)
    return ranking


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    return train_measured(measure(docs), labels)


def score_measured(features: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = features.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        for batch in batches:
            x = np.array(batch["x"].to_list()).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": shared.value.score(x)})

    return frames(features.select("doc_id", "x"), run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    return score_measured(measure(docs), ranking)
