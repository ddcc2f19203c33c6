"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models. A model sees the text features and
the probabilities of all categories before it. In training these are out-of-fold predictions,
so later models meet them as they will be on unseen text. The last category is the one that
rejects a document.

The labels say only whether a text is toxic. The two categories before it are read off the
training texts: ``insult`` (toxic, with at least one abusive term) and ``severe`` (toxic, with
at least three different ones), abusive terms being those that stand out in toxic texts.

Features are the presence of words and of word beginnings, chosen on the training sample, since
languages inflect, and the count of abusive terms. Training takes at most ``SAMPLE`` labelled
documents, picked by a hash of the identifier; all documents are scored on their whole text.

Cases: a null or empty text has no features and the probabilities of such a text; labels without
identifier, value or document are left out, and of repeated ones the toxic one counts; without
any toxic or any clean label, every probability is that share (0, or 1), or 0 with no labels at
all; repeated rows are scored alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import folded, frames
from .linear import fit_logistic, sigmoid

CATEGORIES = ("insult", "severe", "toxic")
SAMPLE = 20_000
TERMS = 512
FOLDS = 3
THRESHOLD = 0.5
# Ridge of the whole sample; each text has its share.
RIDGE = 0.2

# Beginnings of words of these lengths are features too; they end in a hyphen.
BEGINNINGS = (3, 4, 5, 6)
# A term is abusive from this many standard errors of log odds, in small samples from half of what
# the strongest term has; "severe" takes three different words with such terms.
STANDS_OUT = 6.0
SEVERE_TERMS = 3
# Terms are chosen from this many standard errors.
LEAST_Z = 3.0
# A term of the sample occurs in at least so many toxic texts.
LEAST_TEXTS = 3

REMEMBERED_WORDS = 200_000


def words_of(text: str | None) -> set[str]:
    return set(folded([text])[0].split())


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``size`` labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # ``picked`` is bounded by ``size``.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])


def choose_terms(sample: DataFrame, count: int = TERMS) -> pd.DataFrame:
    """The ``count`` terms that speak most for toxic texts: (term, z)."""
    def occurring(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for term in {t for w in words_of(text) for t in terms_of(w)}:
                    seen.setdefault(term, [0, 0])[int(toxic > 0)] += 1
            yield pd.DataFrame([(t, p, n) for t, (n, p) in seen.items()], columns=["term", "pos", "neg"])

    total = sample.agg(F.count_if(F.col("toxic") > 0).alias("pos"), F.count_if(F.col("toxic") <= 0).alias("neg")).first()
    odds = lambda n, of: F.log((n + 0.5) / (F.lit(of) - n + 0.5))
    counts = sample.mapInPandas(occurring, "term string, pos long, neg long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_TEXTS)
    z = (odds(F.col("pos"), total["pos"]) - odds(F.col("neg"), total["neg"])) / F.sqrt(
        1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    return counts.select("term", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(count).toPandas()


class Features:
    """Presence of the chosen terms, and how many abusive ones there are."""

    def __init__(self, chosen: pd.DataFrame):
        self.place = {t: i for i, t in enumerate(chosen["term"])}
        z = chosen["z"].to_numpy(dtype=float)
        self.abusive = (z >= min(STANDS_OUT, z.max(initial=0) / 2)).tolist()
        # Words with a term begin like one.
        self.begin = {t[:min(BEGINNINGS)] for t in self.place}
        self.known: dict[str, tuple[list[int], bool]] = {}
        self.plain: set[str] = set()

    def of_word(self, word: str) -> tuple[list[int], bool]:
        """The places of its terms, and whether one of them is abusive. Those of words without a
        term are remembered in ``plain``."""
        out = self.known.get(word)
        if out is None:
            if len(self.known) + len(self.plain) >= REMEMBERED_WORDS:
                self.forget()
            at = [self.place[t] for t in terms_of(word) if t in self.place]
            out = at, any(self.abusive[i] for i in at)
            if at:
                self.known[word] = out
            else:
                self.plain.add(word)
        return out

    def forget(self) -> None:
        self.known.clear()
        self.plain.clear()

    def matrix(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features and the number of different abusive words of each text."""
        x = np.zeros((len(texts), len(self.place) + 1), dtype=np.float32)
        distinct = np.zeros(len(texts))
        begin, start = self.begin, min(BEGINNINGS)
        for row, text in enumerate(texts):
            places: list[int] = []
            for word in words_of(text) - self.plain:
                if word[:start] in begin:
                    at, abusive = self.of_word(word)
                    places += at
                    distinct[row] += abusive
            x[row, places] = 1
        x[:, -1] = np.log1p(distinct)
        return x, distinct


@dataclass
class Chain:
    """One weight vector a category; each takes the features and the probabilities before it."""

    features: Features
    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        for i, w in enumerate(self.weights):
            full = np.concatenate([x, out[:, :i]], axis=1)
            out[:, i] = sigmoid(full @ w[:-1] + w[-1])
        return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), 40.0 if len(y) and y[0] else -40.0)
    return fit_logistic(x, y, RIDGE / len(x))


def train_chain(features: Features, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """``y`` has a column for each category, in chain order; ``fold`` the fold of each row."""
    weights, before = [], np.zeros((len(x), 0))
    for i in range(y.shape[1]):
        full = np.concatenate([x, before.astype(x.dtype)], axis=1)
        weights.append(_fit(full, y[:, i]))
        if i + 1 < y.shape[1]:
            unseen = np.zeros(len(x))
            for f in np.unique(fold):
                w = _fit(full[fold != f], y[fold != f, i])
                unseen[fold == f] = sigmoid(full[fold == f] @ w[:-1] + w[-1])
            before = np.concatenate([before, unseen[:, None]], axis=1)
    return Chain(features, weights)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Chain:
    sample = store(training_sample(docs, labels, size), "labelled")
    features = Features(choose_terms(sample))

    def rows(batches):
        for batch in batches:
            x, distinct = features.matrix(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "distinct": distinct,
                                "at": [np.flatnonzero(r[:-1]) for r in x]})

    # At most ``size`` rows of the places of their terms.
    got = sample.mapInPandas(rows, "doc_id long, toxic int, distinct double, at array<int>").orderBy(
        "doc_id").toPandas()
    x = np.zeros((len(got), len(features.place) + 1), dtype=np.float32)
    for row, at in enumerate(got["at"]):
        x[row, at] = 1
    distinct = got["distinct"].to_numpy(dtype=float)
    x[:, -1] = np.log1p(distinct)
    toxic = (got["toxic"].to_numpy() > 0).astype(float)
    y = np.stack([toxic * (distinct >= 1), toxic * (distinct >= SEVERE_TERMS), toxic], axis=1)
    return train_chain(features, x, y, np.arange(len(got)) % FOLDS)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the probability of each category and ``toxic``, the verdict."""
    columns = docs.columns
    names = [f"p_{c}" for c in CATEGORIES]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names),
                           T.StructField("toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                frame = batch.iloc[at:at + 1000]
                p = own.predict(own.features.matrix(frame["text"].tolist())[0])
                yield frame[columns].assign(**dict(zip(names, p.T)), toxic=p[:, -1] >= threshold)
        own.features.forget()

    return frames(docs, run, schema)
