"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are scaled to length one and turned by a fixed random rotation; the signs of a turned
vector are its code, and the inner product of the vector with its code (as a unit vector) is
stored as a correction factor. The inner product of one vector's code with another turned
vector, divided by the factor, estimates their cosine without bias, with an error whose spread
is known. Pairs whose estimate cannot reach the similarity within the confidence bound are
dropped; all others are computed again in double precision, which alone decides.

Pairs to estimate come from bands of code bits: vectors of one label that agree on all bits of a
band meet there. The number of bits grows with the logarithm of the number of vectors, so buckets
keep their size, and the number of bands is what makes a pair at exactly the similarity miss all
of them at most once in ``1 / MISS`` times. Buckets over ``BLOCK`` vectors are cut, and each cut
meets each other in a task of its own, so a hot label or group is spread. A pair that agrees on
several bands is counted in the first. Tasks return one row per vector and neighbourhood, never
the pairs: how many it links with, and what it is connected to.

Equal vectors of a label are one class with a weight, compared once.

Cases: null, empty and zero vectors, such with null or non-finite components, and vectors
without a label link with nothing; vectors of different length do not link; a vector without an
identifier takes part, is reported with null and names no component; rows that repeat an
identifier count as separate vectors of one component if they link; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import by_group, components, spread_join

COSINE = 0.93
# A pair at the similarity shares no band in so small a share of cases.
MISS = 1e-5
# Vectors of a bucket that a cut aims at, and that meet in one block.
BLOCK = 2048
# Standard errors within which an estimate is trusted.
CONFIDENCE = 5.0

NO_ID = 1 << 62


def rotation(size: int, seed: int = 4) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed * 1_000_003 + size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def band_plan(n_vectors: int, size: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, number of bands) for tables of ``n_vectors``."""
    bits = max(1, math.ceil(math.log2(max(1, n_vectors / BLOCK))))
    agree = 1 - math.acos(cosine) / math.pi
    bands = math.ceil(math.log(miss) / math.log(1 - agree ** bits))
    return bits, bands


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned unit vectors, their codes as signs, and the correction factors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ turn.T
    signs = np.where(turned >= 0, 1.0, -1.0)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])
    return turned, signs, factor


def estimates(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased cosine of each coded vector (rows) with each turned one (columns)."""
    return (signs @ turned.T) / (math.sqrt(signs.shape[1]) * factor[:, None])


def least_estimate(factor: np.ndarray, size: int, cosine: float, confidence: float = CONFIDENCE) -> np.ndarray:
    """Estimates below this belong to cosines below ``cosine``, up to the confidence: the error is
    the part of the other vector across, times the tangent of the code's angle, over the
    remaining dimensions."""
    spread = np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor / math.sqrt(max(1, size - 1))
    return cosine - confidence * math.sqrt(1 - cosine ** 2) * spread


def band_bits(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Key of each band: the signs after as many rotations as the bands need, in turn."""
    size = x.shape[1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = [unit @ rotation(size, 4 + i).T >= 0 for i in range(math.ceil(bits * bands / size))]
    every = np.concatenate(signs, axis=1)[:, :bits * bands].reshape(len(x), bands, bits)
    return every @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for every row."""
    unnamed = F.lit(NO_ID) + F.xxhash64("embedding").bitwiseAND(F.lit((1 << 60) - 1))
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists(numbers, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    base = vectors.select(F.coalesce("vec_id", unnamed).alias("vec_id"), "label", numbers.alias("v"), odd.alias("odd"))
    base = base.withColumn("fit", F.coalesce(
        F.col("label").isNotNull() & ~F.col("odd") & F.exists("v", lambda v: v != 0), F.lit(False)))
    # A row's vector as one value, equal for equal vectors.
    base = store(base.withColumn("same", F.when(F.col("fit"), F.sha2(F.to_json("v"), 256))), "vectors")
    fit = base.where("fit")
    classes = store(fit.groupBy("label", "same").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")), "classes")
    total = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    bits, bands = band_plan(total[0], total[1] or 1, cosine)

    def keyed(batches):
        for batch in batches:
            for n, part in batch.groupby(batch["v"].str.len()):
                keys = band_bits(_matrix(part["v"]), bits, bands)
                yield part.assign(size=n, keys=list(keys))

    coded = classes.mapInPandas(
        keyed, "label int, same string, node long, weight long, v array<double>, size int, keys array<long>")
    entries = coded.select("label", "size", "node", "same", "weight", "v", "keys", F.posexplode("keys").alias("band", "key"))
    bucket = ["label", "size", "band", "key"]
    counts = coded.select("label", "size", "node", F.posexplode("keys").alias("band", "key")).groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts"))
    # A class is named by its smallest identifier and its content, as identifiers may repeat.
    blocks = spread_join(entries, counts, bucket, "inner").withColumn(
        "mine", F.pmod(F.xxhash64("same", F.lit(1)), F.col("cuts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        *bucket, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine",
        "node", "same", "weight", "v", "keys")

    def compare(key, frame):
        band, i, j = key[2], key[4], key[5]
        if len(frame) < 2:
            return None
        side = frame["mine"].to_numpy()
        x = _matrix(frame["v"])
        keys = np.stack(frame["keys"].to_list())
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        turned, signs, factor = encode(x, rotation(x.shape[1], 3))
        least = least_estimate(factor, x.shape[1], cosine)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        weight = frame["weight"].to_numpy()
        links = np.zeros(len(frame), dtype=np.int64)
        parent = {r: r for r in range(len(frame))}
        for at in range(0, len(left), 256):
            rows = left[at:at + 256]
            maybe = estimates(signs[rows], factor[rows], turned[right]) >= least[rows][:, None]
            if i == j:
                maybe &= right[None, :] > rows[:, None]
            a, b = np.nonzero(maybe)
            a, b = rows[a], right[b]
            for cut in range(0, len(a), 65_536):
                p, q = a[cut:cut + 65_536], b[cut:cut + 65_536]
                linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[linked], q[linked]
                # Counted here only if no earlier band has both.
                new = ~(keys[p, :band] == keys[q, :band]).any(axis=1)
                p, q = p[new], q[new]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                for s, t in zip(p.tolist(), q.tolist()):
                    s, t = find(parent, s), find(parent, t)
                    parent[max(s, t)] = min(s, t)
        touched = np.flatnonzero(links)
        if not len(touched):
            return None
        nodes = frame["node"].to_numpy()
        return pd.DataFrame({"label": key[0], "same": frame["same"].to_numpy()[touched], "node": nodes[touched],
                             "links": links[touched], "root": nodes[[find(parent, r) for r in touched]]})

    found = store(by_group(blocks, [*bucket, "i", "j"], compare,
                           "label int, same string, node long, links long, root long"), "neighbours")
    links = found.groupBy("label", "same").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_node")
    known = classes.select("label", "same", "node", "weight").join(links, ["label", "same"], "left").join(
        roots, F.col("node") == F.col("_node"), "left").select(
        "label", "same", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("component"))
    out = spread_join(base.select("vec_id", "label", "same"), known, ["label", "same"])
    name = F.coalesce("component", "vec_id")
    return out.select(F.when(F.col("vec_id") < NO_ID, F.col("vec_id")).alias("vec_id"),
                      F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.when(name < NO_ID, name).alias("component_id"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])
