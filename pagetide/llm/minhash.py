"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two signature values, the smallest and the
largest hash, so a signature of 2K values costs K permutations; the share of values that two
signatures have in common is an unbiased estimate of their Jaccard similarity, of lower variance
than 2K independent minima. Signatures are cut into bands; sets that agree on a band are
candidates, and every link is confirmed on the full sets of the two texts.

Work stays bounded in hot groups. Equal sets are one class from the start. In a band's bucket
every class is first compared with the smallest one only, and what is linked is one from then
on. Classes of a bucket that are still apart, but may be similar by their signatures, are tied
into families, by a forest of at most one tie a class. Members of a family meet in blocks, with
their texts, and pairs that are not connected yet are confirmed there, likeliest first; a block
returns only the links that connect something new. So every pair of a bucket is either connected
already, ruled out by its signatures, or confirmed or refuted on its full sets, and no group is
ever expanded into rows for its pairs.

Cases: a null, empty or blank text has an empty set and links with nothing; with fewer words
than a shingle, the whole sequence is the only shingle; rows that repeat an identifier are one
document and link if any of them does: each of their texts is compared as its own, and in
``near_duplicates``, not in ``row_groups``, a link ties them; a row without an identifier takes
part, stands after all others, and is reported with null (identifiers must be under 2**62); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import (Words, by_group, components, filtered, in_pieces, mix, runs_of, signed, spread_join, tidy, windows)

# 50 permutations, 100 values, 25 bands of 4: sets of similarity 0.8 share no band in one of
# 500,000 cases.
PERMUTATIONS = 50
BAND = 4
SIMILARITY = 0.8

# Pairs whose signatures agree less than this are not compared in full: more than four standard
# deviations under 0.8 with 100 values.
LEAST_ESTIMATE = 0.62

# Rows without an identifier get one from here on, by their text.
NO_ID = 1 << 62

# So do the texts of an identifier that has several, by identifier and text.
REPEATED = NO_ID + (1 << 61)

# Classes that meet in one block.
BLOCK = 1024

_RNG = np.random.default_rng(8)
_MULTIPLY = (_RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)

# Sets are permuted so many shingles at a time, so that they stay near the processor.
_STEP = 8192


def signatures(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row for each set ``items[first[i]:first[i + 1]]``, none of them empty: smallest and largest
    value under each permutation, as 32-bit values in turn."""
    low = np.full((len(first) - 1, PERMUTATIONS), np.uint64(2**64 - 1))
    high = np.zeros((len(first) - 1, PERMUTATIONS), dtype=np.uint64)
    for at in range(0, len(items), _STEP):
        own = items[at:at + _STEP]
        # the sets that have a part here, and where the parts begin
        a, b = np.searchsorted(first, at, side="right") - 1, np.searchsorted(first, at + len(own))
        parts = np.maximum(first[a:b] - at, 0)
        values, moved = np.empty_like(own), np.empty_like(own)
        for p in range(PERMUTATIONS):
            np.multiply(own, _MULTIPLY[p], out=values)
            values += _ADD[p]
            np.right_shift(values, np.uint64(32), out=moved)
            values ^= moved
            values *= np.uint64(0xD6E8FEB86659FD93)
            low[a:b, p] = np.minimum(low[a:b, p], np.minimum.reduceat(values, parts))
            high[a:b, p] = np.maximum(high[a:b, p], np.maximum.reduceat(values, parts))
    return (np.stack([low, high], axis=2).reshape(len(low), -1) >> np.uint64(32)).astype(np.uint32)


def signature(items: np.ndarray) -> np.ndarray:
    """The one of a single set."""
    return signatures(items, np.array([0, len(items)]))[0]


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each run of BAND signature values, which are along the last axis."""
    out = np.full((*values.shape[:-1], values.shape[-1] // BAND), np.uint64(0x51ED270B))
    for i in range(BAND):
        out = mix(out ^ values[..., i::BAND].astype(np.uint64))
    return out


def distinct_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle sets of all texts, one after another, and the bounds of each."""
    text, start, end = runs_of(words, k)
    items = windows(words.hashes, start, end)
    cuts = np.searchsorted(text, np.arange(len(words.first)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        items[a:b].sort()
    new = np.ones(len(items), dtype=bool)
    new[1:] = (items[1:] != items[:-1]) | (text[1:] != text[:-1])
    return items[new], np.concatenate([[0], np.cumsum(new)])[cuts]


def numbered(docs: DataFrame) -> DataFrame:
    """(name, row, size, doc_id, text): the given identifier, a hash of it and the text, the length
    of the text, and a number that no two texts share."""
    mark = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where(
        "a <> b").select("doc_id", F.lit(True).alias("several"))
    row = F.xxhash64("doc_id", "text")
    return spread_join(docs.select("doc_id", "text"), several, ["doc_id"]).select(
        F.col("doc_id").alias("name"), row.alias("row"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("several"), F.lit(REPEATED) + row.bitwiseAND(F.lit((1 << 61) - 1))).otherwise(F.coalesce(
            "doc_id", F.lit(NO_ID) + mark.bitwiseAND(F.lit((1 << 60) - 1)))).alias("doc_id"), "text")


def sketches(docs: DataFrame, k: int, lower: bool = True) -> DataFrame:
    """(name, row, size, doc_id, n_shingles, set_a, set_b, bands, marks): the columns of ``numbered``,
    size and 128-bit identity of each set, its band keys, and the low byte of every signature value."""
    own = ["name", "row", "size", "doc_id"]

    def run(batches):
        for batch in batches:
            for frame in in_pieces(batch, "text"):
                items, first = distinct_shingles(Words(frame["text"].tolist(), lower), k)
                size = np.diff(first)
                full = np.flatnonzero(size)
                found = pd.DataFrame({"n_shingles": size, "set_a": 0, "set_b": 0, "bands": None, "marks": None})
                if len(full):
                    values = signatures(items, first[np.append(full, len(size))])
                    found.loc[full, "set_a"] = signed(np.add.reduceat(items, first[full]))
                    found.loc[full, "set_b"] = signed(np.bitwise_xor.reduceat(mix(items), first[full]))
                    found.loc[full, "bands"] = pd.Series([*signed(band_keys(values))], index=full)
                    found.loc[full, "marks"] = pd.Series([v.tobytes() for v in values.astype(np.uint8)], index=full)
                # Arrow gives identifiers with nulls as floats; they came as text, to stay exact.
                ids = frame[own].reset_index(drop=True).astype({"name": "string"}).astype({"name": "Int64"})
                yield pd.concat([ids, found], axis=1)

    return docs.select(F.col("name").cast("string").alias("name"), *own[1:], "text").mapInPandas(
        tidy(run), "name long, row long, size long, doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, marks binary")


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets."""
    least, most = sorted((len(left), len(right)))
    if 100 * least < percent * most:
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def shingle_sets(texts, k: int, lower: bool) -> list[np.ndarray]:
    items, first = distinct_shingles(Words(texts, lower), k)
    return np.split(items, first[1:-1])


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: float, lower: bool = True) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``texts``: (node, text), one row each."""
    percent = round(100 * similarity)

    def run(batches):
        for batch in batches:
            for frame in in_pieces(batch, "text_a"):
                hubs = frame.drop_duplicates("b")
                right = dict(zip(hubs["b"], shingle_sets(hubs["text_b"].tolist(), k, lower)))
                left = shingle_sets(frame["text_a"].tolist(), k, lower)
                kept = [(a, b) for a, b, own in zip(frame["a"], frame["b"], left) if similar(own, right[b], percent)]
                yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    text_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    text_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b").mapInPandas(
        tidy(run), "a long, b long")


def in_blocks(df: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """Rows of a group as (i, j, mine): groups of more than BLOCK rows are cut by ``node``, and each
    cut meets each other, and itself, in a block of its own."""
    cuts = counts.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts"))
    return spread_join(df, cuts, keys, "inner").withColumn(
        "mine", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns(
        {"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "cuts")


def _sides(key, frame) -> tuple[np.ndarray, np.ndarray]:
    side = frame["mine"].to_numpy()
    return np.flatnonzero(side == key[-2]), np.flatnonzero(side == key[-1])


def _marks(frame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["marks"]), dtype=np.uint8).reshape(len(frame), -1)


def still_apart(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): a forest that ties all classes of a bucket that may be similar and are not connected."""
    e = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = e.groupBy("band", "key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"),
                                         F.count(F.lit(1)).alias("n")).where("r1 <> r2")
    blocks = in_blocks(e, ["band", "key"], mixed).select("band", "key", "i", "j", "mine", "node", "root", "marks")

    def tie(key, frame):
        if len(frame) < 2:
            return None
        left, right = _sides(key, frame)
        node, root, marks = frame["node"].to_numpy(), frame["root"].to_numpy(), _marks(frame)
        tree = np.arange(len(frame))
        out = []
        for x in left:
            near = right[((marks[right] == marks[x]).mean(axis=1) >= LEAST_ESTIMATE) & (root[right] != root[x])]
            trees, first = np.unique(tree[near], return_index=True)
            new = trees != tree[x]
            out += [(node[x], node[y]) for y in near[first[new]]]
            tree[np.isin(tree, trees)] = tree[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64") if out else None

    return by_group(blocks, ["band", "key", "i", "j"], tie, "a long, b long").distinct()


def within_families(families: DataFrame, roots: DataFrame, marks: DataFrame, texts: DataFrame, k: int,
                    similarity: float, lower: bool = True) -> DataFrame:
    """(a, b): confirmed links between members of a family that connect what ``roots`` leaves apart."""
    percent = round(100 * similarity)
    members = families.select("node", F.col("root").alias("family"))
    counts = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    full = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(
        marks, "node").join(texts, "node")
    blocks = in_blocks(full, ["family"], counts).select("family", "i", "j", "mine", "node", "root", "marks", "text")

    def link(key, frame):
        if len(frame) < 2:
            return None
        left, right = _sides(key, frame)
        node, marks = frame["node"].to_numpy(), _marks(frame)
        tree = np.unique(frame["root"].to_numpy(), return_inverse=True)[1]
        sets = shingle_sets(frame["text"].tolist(), k, lower)
        out = []
        for x in left:
            share = (marks[right] == marks[x]).mean(axis=1)
            likely = np.argsort(-share, kind="stable")
            for y in right[likely[:int((share >= LEAST_ESTIMATE).sum())]]:
                if tree[x] != tree[y] and similar(sets[x], sets[y], percent):
                    out.append((node[x], node[y]))
                    tree[tree == tree[y]] = tree[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64") if out else None

    return by_group(blocks, ["family", "i", "j"], link, "a long, b long")


def row_groups(docs: DataFrame, k: int, similarity: float = SIMILARITY, lower: bool = True, ties: bool = False) -> DataFrame:
    """(name, row, size, n_shingles, root) for every row, the first three as in ``numbered``; rows of
    one root are linked. With ``ties``, so are all texts of an identifier, by that."""
    documents = numbered(docs)
    base = store(sketches(documents, k, lower), "sketches")
    sets = ["n_shingles", "set_a", "set_b"]
    full = base.where("n_shingles > 0")
    shared = full.groupBy(*sets).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").drop("n")
    member = store(spread_join(base.select("name", "row", "size", "doc_id", *sets), shared, sets).select(
        "name", "row", "size", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id"))
        .otherwise(F.col("doc_id")).alias("node")), "classes")
    # Only documents that stand for a class go on; equal rows are one node.
    nodes = member.where("n_shingles > 0").select("node").distinct()
    classes = full.join(nodes, F.col("doc_id") == F.col("node")).groupBy("node", *sets).agg(
        F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    entries = classes.select("node", "marks", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where(
        "hub <> far").drop("far")
    entries = store(spread_join(entries, buckets, ["band", "key"], "inner"), "buckets")
    pool = entries.select("node").distinct()
    texts = store(filtered(documents, pool, "doc_id", "node").join(pool, F.col("doc_id") == F.col("node"))
                  .groupBy("node", "text").agg(F.lit(1)).select("node", "text"), "pool")
    first = store(confirmed(entries.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
                            .distinct(), texts, k, similarity, lower), "confirmed")
    if ties:
        first = first.union(member.where(F.col("doc_id") >= REPEATED).select("name", "node").distinct())
    roots = components(first)
    families = components(still_apart(entries.drop("hub"), roots))
    marks = entries.groupBy("node").agg(F.min("marks").alias("marks"))
    second = store(within_families(families, roots, marks, texts, k, similarity, lower), "confirmed")
    roots = components(first.union(second))
    return spread_join(member, roots, ["node"]).select(
        "name", "row", "size", "n_shingles", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, k: int, similarity: float = SIMILARITY, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    return row_groups(docs, k, similarity, lower, ties=True).select(
        F.col("name").alias("doc_id"), "n_shingles", F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))


