"""Helpers that several operators of this subpackage share.

Word arithmetic is done in numpy on the UTF-8 bytes of many texts at once; data movement is
left to Spark.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, ship, store

# The separators of words: space, and U+0009 to U+000D.
SEPARATORS = (32, 9, 10, 11, 12, 13)

# Texts are hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 19

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# What no folded word has: among ASCII characters by a table, among all others by a pattern.
_GAPS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_OTHER_GAPS = re.compile(r"[^\w\x00-\x7F]")

_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xD1B54A32D192ED03 | 1)


# What a worker keeps from task to task, by the operator that uses it: how to let it go.
HELD: dict[str, Callable[[], None]] = {}


def tidy(run: Callable, owner: str | None = None) -> Callable:
    """Give back what a task's Arrow and numpy buffers leave in the allocators, the tables of powers,
    and what other operators than ``owner`` keep: workers stay alive between tasks, and several
    of them share an executor."""
    @functools.wraps(run)
    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        for name in [n for n in HELD if n != owner]:
            HELD.pop(name)()
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows and bytes of one batch that a task hands to Python; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep their batches small. Every query calls it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def frames(df: DataFrame, run: Callable, schema: str | T.StructType, owner: str | None = None) -> DataFrame:
    """``mapInPandas`` that keeps whole numbers whole. A column of them with nulls in a batch reaches
    ``run`` as Python objects; as doubles, identifiers above 2**53 would change."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def wrapped(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for frame in run(batch.to_pandas(integer_object_nulls=True) for batch in batches):
            yield pa.RecordBatch.from_pandas(frame, schema=shape, preserve_index=False)

    return df.mapInArrow(tidy(wrapped, owner), schema)


def whole(values: Sequence[int | None]) -> pd.Series:
    """A column of whole numbers and nulls."""
    return pd.Series(values, dtype=object)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64; one table a base, which grows by doubling and is kept."""
    if len(_POWERS.get(int(base), ())) < n:
        table = np.full(1 << max(10, int(n - 1).bit_length()), base, dtype=np.uint64)
        table[0] = 1
        _POWERS[int(base)] = np.cumprod(table, dtype=np.uint64)
    return _POWERS[int(base)][:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of each span [start, end) of ``values``: a polynomial independent of its place."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)) if len(values) else values, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(inverse(base), int(starts.max()) + 1)[starts]
               + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)


def folded(texts: Iterable[str | None]) -> list[str]:
    """Texts with everything but letters and digits as spaces, in lower case."""
    # bytes under 128 are ASCII characters in UTF-8, wherever they stand
    plain = ["" if t is None else t.lower().encode("utf-8").translate(_GAPS).decode("utf-8") for t in texts]
    return [t if t.isascii() else _OTHER_GAPS.sub(" ", t) for t in plain]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at separators, about PIECE_BYTES apart; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data):
            gap = np.flatnonzero(_IS_SPACE[data[end:end + PIECE_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end += PIECE_BYTES
        yield at, min(end, len(data))
        at = end


class Words:
    """Hashes of the words of several texts, in order. ``first[i]:first[i+1]`` are text i's."""

    def __init__(self, texts: Sequence[str | None], lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8") for t in texts]
        data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
        if lower:
            data = _LOWER[data]
        lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        place = np.concatenate([[0], np.cumsum(lengths)])
        starts, ends, hashes = [], [], []
        for a, b in _pieces(data):
            s, e = word_spans(data[a:b])
            hashes.append(span_sums(_BYTE_VALUE[data[a:b]], s, e, _BYTE_BASE))
            starts.append(s + a)
            ends.append(e + a)
        empty = np.zeros(0, dtype=np.int64)
        self.data, self.place = data, place
        self.starts = np.concatenate([empty, *starts])
        self.ends = np.concatenate([empty, *ends])
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.first = np.searchsorted(self.starts, place)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i]:self.first[i + 1]]

    def texts_of(self, i: int) -> list[bytes]:
        """The words of text i as bytes."""
        raw = self.data
        a, b = self.first[i], self.first[i + 1]
        return [raw[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b])]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; with fewer words, of the whole sequence; of none, nothing."""
    n = len(words)
    if n == 0:
        return words
    starts = np.arange(max(1, n - k + 1), dtype=np.int64)
    return span_sums(words, starts, np.minimum(starts + k, n), _WORD_BASE)


def runs_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each run of ``k`` words in all texts at once, in order: the spans that
    ``shingles`` hashes text by text."""
    size = np.diff(words.first)
    count = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    text = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(text)) + (words.first[:-1] - np.cumsum(count) + count)[text]
    return text, start, np.minimum(start + k, words.first[1:][text])


def windows(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_sums(words, starts, ends, _WORD_BASE)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def in_pieces(frame: pd.DataFrame, column: str, limit: int = PIECE_BYTES) -> Iterator[pd.DataFrame]:
    """Slices of ``frame`` of about ``limit`` characters; one longer text is a slice of its own."""
    size = frame[column].str.len().fillna(0).to_numpy() + 1
    group = (np.cumsum(size) // limit).astype(np.int64)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(frame)]):
        if a < b:
            yield frame.iloc[a:b]


def by_group(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame | None],
             schema: str) -> DataFrame:
    """Apply ``fn`` to each group. Rows are dealt by the keys, sorted by Spark, and cut into groups
    while they stream by, so many small groups cost little. Groups must be of bounded size."""
    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            whole = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
            k = whole[keys]
            new = (k != k.shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero(new)
            for a, b in zip(cuts[:-1], cuts[1:]):
                got = fn(tuple(k.iloc[a]), whole.iloc[a:b])
                if got is not None and len(got):
                    yield got
            held = [whole.iloc[cuts[-1]:]]
        if held:
            last = held[0]
            got = fn(tuple(last[keys].iloc[0]), last)
            if got is not None and len(got):
                yield got

    return df.repartition(width(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(tidy(run), schema)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join where one key may own a large part of ``left``; ``right`` has one row a key at most.

    ``right`` is written first. Both sides are then plain shuffled tables, so adaptive execution
    splits the tasks of hot keys by their measured size (or sends ``right`` round if it is small),
    which it cannot where the join reuses the partitioning of an aggregation.
    """
    return left.join(store(right, "side"), keys, how)


# A filter of so many bits (2 MB) is sent to every task. Its size is fixed; with more keys than
# it can tell apart it lets more rows through, and the join behind it decides.
FILTER_BITS = 1 << 24


def _slots(values: np.ndarray) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64)) >> np.uint64(40)).astype(np.int64)


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bit table of the values of an integer column. Spark merges the bits; at most FILTER_BITS / 32
    words come back."""
    def slots(batches):
        for batch in batches:
            slot = np.unique(_slots(batch[column].dropna().to_numpy()))
            yield pd.DataFrame({"word": (slot >> 5).astype(np.int64), "bit": np.int64(1) << (slot & 31)})

    got = keys.select(column).mapInPandas(slots, "word long, bit long").groupBy("word").agg(
        F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 5, dtype=np.uint32)
    out[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def may_hold(table_: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = _slots(values)
    return (table_[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def filtered(df: DataFrame, keys: DataFrame, column: str, key_column: str | None = None,
             keep: bool = True) -> DataFrame:
    """Rows whose ``column`` may be among the keys (or, with ``keep=False``, surely is not).
    Rows without a value are never among the keys."""
    shared = df.sparkSession.sparkContext.broadcast(key_filter(keys, key_column or column))

    def run(batches):
        for batch in batches:
            value = batch.column(column)
            hit = may_hold(shared.value, value.fill_null(0).to_numpy(zero_copy_only=False)) & ~np.asarray(
                value.is_null())
            yield batch.filter(_mask(hit if keep else ~hit))

    return df.mapInArrow(tidy(run), df.schema)


def marked(df: DataFrame, column: str, **keys: DataFrame) -> DataFrame:
    """``df`` with a flag for each of ``keys``: whether ``column``, a number that is never null, may be
    among its values. One pass for all, so a task needs one Python worker."""
    shared = df.sparkSession.sparkContext.broadcast([key_filter(k, column) for k in keys.values()])
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.BooleanType()) for name in keys)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            value = batch.column(column).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(may_hold(bits, value)) for bits in shared.value)], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def _mask(hit: np.ndarray):
    import pyarrow as pa

    return pa.array(hit)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reachable;
    only nodes with an edge appear.

    Alternates two steps until nothing changes: every neighbour larger than a node is tied to the
    smallest around that node, then every node and its smaller neighbours to their smallest. Each
    step is two aggregations that combine before the shuffle; no node's neighbours are collected.
    Every round is written to the shared folder.
    """
    edges = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = store(small, "links")
        discard(edges)
        edges = after
    return store(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v"), F.col("v")).distinct()), "components")
