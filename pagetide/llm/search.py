"""Ranked search over all documents by reading impact-sorted lists without random access.

Documents are cut into blocks of bounded size. In a block each query term has one list of its
documents, largest impact first. An item's lists are read from the front, a longer stretch each
round, and every document met has an interval for its score: from the sum of the impacts read, to
that sum plus, for each list where it has not been met, the impact at that list's front. A
document whose upper end falls below the score that the k-th best is sure to reach goes; when no
document not yet met can reach that score either, reading goes on for those left until lower and
upper ends are one, so membership, ties and scores are final. The k-th best score to beat is first
taken over all blocks from a short read of each, so that most blocks end after few rounds.

The query set is cut into parts of at most ``PART_TERMS`` different terms (one longer item is a
part of its own), whose vocabulary is sent to the workers.

Cases: a null or empty text has no terms, is in no list and not counted; very long texts are one
row each; equal scores go by ascending identifier, nulls last; repeated documents, and documents of
one identifier, are ranked each for itself, as are repeated items; an empty table of documents or
items gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import tidy

PART_TERMS = 65_536
BLOCK_DOCS, BLOCK_POSTINGS = 4_096, 1 << 18
# Postings of a list that the first round reads; each later round reads twice as many.
FIRST_READ = 64

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True
_TABLE = bytes(b + 32 if 65 <= b < 91 else b if _WORD[b] else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: ASCII letters and digits and all characters beyond ASCII, with only A-Z
    lowered."""
    return (text or "").encode("utf-8").translate(_TABLE).split(b" ")


def count_terms(text: str | None, wanted: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms of a text, and how often it holds each wanted one."""
    n, found = 0, {}
    for term in terms(text):
        if term:
            n += 1
            at = wanted.get(term)
            if at is not None:
                found[at] = found.get(at, 0) + 1
    return n, found


def query_parts(items: DataFrame, item: str, text: str) -> DataFrame:
    """One row per part of the query set: the item identifiers, and the different terms of each."""
    id_type = items.schema[item].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("terms", T.ArrayType(T.ArrayType(T.BinaryType())))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        shape = [pa.list_(to_arrow_type(id_type)), pa.list_(pa.list_(pa.binary()))]

        def part(ids, sets):
            return pa.RecordBatch.from_arrays([pa.array([ids], shape[0]), pa.array([sets], shape[1])], names=["ids", "terms"])

        ids, sets, size = [], [], 0
        for batch in batches:
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = sorted(set(terms(value)) - {b""})
                if ids and size + len(mine) > PART_TERMS:
                    yield part(ids, sets)
                    ids, sets, size = [], [], 0
                ids.append(id_)
                sets.append(mine)
                size += len(mine)
        if ids:
            yield part(ids, sets)

    # parts are packed inside partitions: a few hundred bytes an item, so some thousand items each
    n = max(1, items.count() // 4_096)
    return items.select(item, text).repartition(n).mapInArrow(tidy(run), schema)


def _counted(docs: DataFrame, id_: str, text: str, wanted) -> DataFrame:
    """Per document with terms: its length and its postings for the wanted terms."""
    schema = T.StructType([T.StructField("id", docs.schema[id_].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyarrow as pa

        ints = pa.list_(pa.int32())
        for batch in batches:
            got = [count_terms(t, wanted.value) for t in batch.column(1).to_pylist()]
            some = [n > 0 for n, _ in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in got], pa.int64()),
                 pa.array([list(f) for _, f in got], ints), pa.array([list(f.values()) for _, f in got], ints)],
                names=["id", "n", "terms", "tfs"]).filter(pa.array(some, pa.bool_()))

    return docs.select(id_, text).mapInArrow(tidy(run), schema)


def _blocks(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks of documents with the lists of their terms, one row each. List ``i`` belongs to term
    ``terms[i]`` and covers ``starts[i]:starts[i + 1]`` of ``docs`` (places in ``ids``) and ``parts``
    (impact without the term's weight), largest part first."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(counted.schema["id"].dataType))] + [
        T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "starts", "docs", "parts")])

    def run(batches):
        import pyarrow as pa

        def block(held: pa.Table):
            length = np.asarray(held.column("n"))
            lists = held.column("terms").combine_chunks()
            sizes = np.diff(np.asarray(lists.offsets))
            term = np.asarray(lists.flatten(), dtype=np.int64)
            tf = np.asarray(held.column("tfs").combine_chunks().flatten(), dtype=np.int64)
            doc = np.repeat(np.arange(len(length)), sizes)
            m = 50 + 50 * length * n_docs // n_terms
            part = 1_000_000_000 * tf // (1_000 * tf + 20 * m[doc])
            order = np.lexsort((doc, -part, term))
            term, doc, part = term[order], doc[order], part[order]
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            ints = pa.list_(pa.int32())
            ids = held.column("id").combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *[pa.array([a.astype(np.int32)], ints) for a in (term[starts], np.append(starts, len(term)), doc, part)]],
                names=["ids", "terms", "starts", "docs", "parts"])

        held, docs, postings = [], 0, 0
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            at = 0
            for i, size in enumerate(sizes.tolist()):
                if docs and (docs == BLOCK_DOCS or postings + size > BLOCK_POSTINGS):
                    held.append(batch.slice(at, i - at))
                    yield block(pa.Table.from_batches(held))
                    held, docs, postings, at = [], 0, 0, i
                docs, postings = docs + 1, postings + size
            held.append(batch.slice(at))
        if docs:
            yield block(pa.Table.from_batches(held))

    return counted.mapInArrow(tidy(run), schema)


class _Lists:
    """An item's lists in one block, with the intervals of the scores met so far."""

    def __init__(self, row: dict, places: np.ndarray, weights: np.ndarray):
        starts = row["starts"]
        self.docs = [row["docs"][starts[p]:starts[p + 1]] for p in places]
        self.impacts = [w * row["parts"][starts[p]:starts[p + 1]].astype(np.int64) for p, w in zip(places, weights)]
        n = len(row["ids"])
        self.lower = np.zeros(n, dtype=np.int64)
        self.seen = np.zeros((len(places), n), dtype=bool)
        self.read = [0] * len(places)
        self.front = np.array([i[0] if len(i) else 0 for i in self.impacts], dtype=np.int64)

    def advance(self, size: int) -> None:
        """Read ``size`` more postings of each list."""
        for i, (docs, impacts) in enumerate(zip(self.docs, self.impacts)):
            a = self.read[i]
            if a == len(docs):
                continue
            b = self.read[i] = min(len(docs), a + size)
            self.lower[docs[a:b]] += impacts[a:b]
            self.seen[i, docs[a:b]] = True
            self.front[i] = impacts[b - 1] if b < len(docs) else 0

    @property
    def ended(self) -> bool:
        return not self.front.any()

    def best(self, k: int) -> np.ndarray:
        """The k largest lower ends, or fewer."""
        sure = self.lower[self.lower > 0]
        return np.sort(sure)[::-1][:k]

    def resolve(self, k: int, least: int) -> np.ndarray:
        """Read until the documents that may be among the k best and reach ``least`` are known with
        their final scores; their places. More than k only with ties at the end."""
        size = FIRST_READ
        while True:
            mine = self.best(k)
            goal = max(least, int(mine[-1]) if len(mine) == k else 1)
            total = int(self.front.sum())
            upper = self.lower + (total - self.front @ self.seen)
            left = np.flatnonzero((upper >= goal) & ((self.lower > 0) | (total > 0)))
            if self.ended or (total < goal and np.array_equal(upper[left], self.lower[left])):
                return left[self.lower[left] >= goal]
            self.advance(size)
            size *= 2


def _by_item(row: dict, part: dict) -> Iterator[tuple[int, _Lists]]:
    """The items that have a term in the block, with their lists."""
    for number, wanted in enumerate(part["items"]):
        at = np.searchsorted(row["terms"], wanted)
        hit = (at < len(row["terms"])) & (row["terms"][np.minimum(at, len(row["terms"]) - 1)] == wanted)
        hit &= part["weights"][wanted] > 0
        if hit.any():
            yield number, _Lists(row, at[hit], part["weights"][wanted[hit]])


def _rows(batch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].values for c in batch.schema.names}
        yield {c: v if c == "ids" else v.to_numpy(zero_copy_only=False) for c, v in row.items()}


def _goals(blocks: DataFrame, part, k: int, n_items: int) -> np.ndarray:
    """For each item a score that at least k documents are sure to reach, or 1. From the first
    stretch of every list; each task sends its k best scores of an item."""
    def run(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in _rows(batch):
                if not len(row["terms"]):
                    continue
                for number, lists in _by_item(row, part.value):
                    lists.advance(FIRST_READ)
                    both = np.concatenate([held.get(number, np.zeros(0, np.int64)), lists.best(k)])
                    held[number] = np.sort(both)[::-1][:k]
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(np.repeat(list(held), [len(v) for v in held.values()]).astype(np.int32) if held else [], pa.int32()),
            "score": pa.array(np.concatenate(list(held.values())) if held else [], pa.int64())})

    sure = blocks.mapInArrow(tidy(run), "item int, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    kth = sure.withColumn("place", place).where(F.col("place") <= k).groupBy("item").agg(
        F.max("place").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    goals = np.ones(n_items, dtype=np.int64)
    for row in kth.collect():  # one row an item of this part
        goals[row.item] = row.score
    return goals


def _ranked(blocks: DataFrame, part, k: int, id_type, item_type, item: str, id_: str) -> DataFrame:
    schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField(item, item_type),
                           T.StructField(id_, id_type), T.StructField("score", T.LongType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        given = part.value
        for batch in batches:
            for row in _rows(batch):
                if not len(row["terms"]):
                    continue
                numbers, places, scores = [], [], []
                for number, lists in _by_item(row, given):
                    found = lists.resolve(k, int(given["goals"][number]))
                    score = lists.lower[found]
                    if len(found) > k:  # ties at the end: the smallest identifiers
                        first = pc.sort_indices(pa.table({"s": score, "i": row["ids"].take(pa.array(found))}),
                                                [("s", "descending"), ("i", "ascending")], null_placement="at_end")
                        found, score = found[first[:k].to_numpy()], score[first[:k].to_numpy()]
                    numbers += [number] * len(found)
                    places.append(found)
                    scores.append(score)
                if numbers:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers, pa.int32()),
                         pa.array([given["ids"][n] for n in numbers], to_arrow_type(item_type)),
                         row["ids"].take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores), pa.int64())],
                        names=schema.names)

    found = blocks.mapInArrow(tidy(run), schema)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last(id_))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_: str = "doc_id", item: str = "item_id",
                   text: str = "text") -> DataFrame:
    """(item, rank, document, score): the k documents of highest score above 0 for each row of ``items``."""
    spark = docs.sparkSession
    out = None
    for given in store(query_parts(items, item, text), "queries").toLocalIterator():
        vocabulary = sorted(set().union(*map(frozenset, given.terms)))
        wanted = {bytes(term): i for i, term in enumerate(vocabulary)}
        counted = store(_counted(docs, id_, text, spark.sparkContext.broadcast(wanted)), "counted")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = {r[0]: r[1] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1)))
                            for i in range(len(wanted))], dtype=np.int64)
        part = {"ids": list(given.ids), "weights": weights,
                "items": [np.array(sorted(wanted[bytes(t)] for t in mine), dtype=np.int32) for mine in given.terms]}
        blocks = store(_blocks(counted, n_docs, n_terms), "blocks")
        part["goals"] = _goals(blocks, spark.sparkContext.broadcast(part), k, len(part["ids"]))
        ranked = store(_ranked(blocks, spark.sparkContext.broadcast(part), k, docs.schema[id_].dataType,
                               items.schema[item].dataType, item, id_), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    schema = T.StructType([T.StructField(item, items.schema[item].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_, docs.schema[id_].dataType), T.StructField("score", T.LongType())])
    return spark.createDataFrame([], schema) if out is None else out.select(*schema.names)
