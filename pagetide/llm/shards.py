"""Fixed virtual slots: records hash into slots for good, slots are mapped to shards by a
versioned table, and rebalancing edits that table instead of rehashing records.

The number of slots never changes with the data, so the slot totals and the map have a fixed
bound and may pass through the driver. Record text never moves: only identifiers, sizes and
checksums are shuffled.

Cases: a null or empty text has zero bytes and size 1; a null identifier is a value like any
other; rows equal in identifier and text are separate records with neighbouring positions in
an arbitrary order among themselves; an empty table gives no rows and a map of empty slots;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store

SLOTS = 4096
SHARDS = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(n_slots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n_slots)).cast("int")


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0, before anything is known of the data: slots dealt in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def edit_map(shard_of: Sequence[int], size: Mapping[int, int], n_shards: int) -> list[int]:
    """The next version: shards over their share give up slots until they fit, and the given
    slots go, largest first, to whichever shard is smallest. Then slots move or change places
    between the fullest and the emptiest shard as long as that narrows the gap."""
    out = list(shard_of)
    goal = sum(size.values()) / n_shards
    load = [0] * n_shards
    free = []
    held: list[set[int]] = [set() for _ in range(n_shards)]
    for slot in sorted(range(len(out)), key=lambda s: (-size.get(s, 0), s)):
        shard, weight = out[slot], size.get(slot, 0)
        if shard < n_shards and load[shard] + weight <= goal:
            load[shard] += weight
            held[shard].add(slot)
        else:
            free.append(slot)
    for slot in free:
        shard = min(range(n_shards), key=lambda s: (load[s], s))
        load[shard] += size.get(slot, 0)
        held[shard].add(slot)
        out[slot] = shard
    settled: set[int] = set()  # fullest shards that nothing can be taken from
    for _ in range(8 * n_shards):
        open_ones = [s for s in range(n_shards) if s not in settled]
        if len(open_ones) < 2:
            break
        high, low = max(open_ones, key=load.__getitem__), min(open_ones, key=load.__getitem__)
        gap = load[high] - load[low]
        best = (0, None, None)
        smaller = sorted((size.get(s, 0), s) for s in held[low])
        for slot in held[high]:
            weight = size.get(slot, 0)
            if 0 < weight < gap:
                best = max(best, (min(weight, gap - weight), slot, -1))
            at = _nearest(smaller, weight - gap / 2)
            if at is not None and 0 < weight - at[0] < gap:
                moved = weight - at[0]
                best = max(best, (min(moved, gap - moved), slot, at[1]))
        gain, slot, other = best
        if gain == 0:
            settled.add(high)
            continue
        for s, a, b in ((slot, high, low), (other, low, high)):
            if s >= 0:
                held[a].discard(s)
                held[b].add(s)
                load[a] -= size.get(s, 0)
                load[b] += size.get(s, 0)
                out[s] = b
    return out


def _nearest(pairs: list[tuple[int, int]], weight: float) -> tuple[int, int] | None:
    import bisect

    at = bisect.bisect_left(pairs, (weight, -1))
    near = pairs[max(0, at - 1):at + 1]
    return min(near, key=lambda p: abs(p[0] - weight)) if near else None


def map_versions(spark: SparkSession, versions: Sequence[Sequence[int]]) -> DataFrame:
    """(version, slot, shard), stored; a reader takes the highest version."""
    rows = [(v, slot, shard) for v, shards in enumerate(versions) for slot, shard in enumerate(shards)]
    return store(spark.createDataFrame(rows, "version int, slot int, shard int"), "slot_map")


def assign(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, position, map_version) for every row.

    ``position`` numbers the records of a shard from 0, by slot and identifier: a window inside
    each slot plus the summed counts of the shard's slots before it, so no shard is sorted as a
    whole.
    """
    spark = docs.sparkSession
    records = store(
        docs.select("doc_id", record_size(F.col("text")).alias("size"),
                    F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
        .withColumn("virtual_slot", virtual_slot(n_slots, "doc_id", "text_crc32", "size")), "records")
    totals = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    start = first_map(n_slots, n_shards)
    edited = edit_map(start, {r["virtual_slot"]: r["bytes"] for r in totals}, n_shards)
    versions = map_versions(spark, [start, edited])
    count = {r["virtual_slot"]: r["n"] for r in totals}
    before, seen = [], [0] * n_shards
    for slot, shard in enumerate(edited):
        before.append((slot, seen[shard]))
        seen[shard] += count.get(slot, 0)
    offsets = spark.createDataFrame(before, "slot int, before long")
    current = versions.where(F.col("version") == 1).join(offsets, "slot").select(
        F.col("slot").alias("virtual_slot"), "shard", "before", F.col("version").alias("map_version"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    inside = records.withColumn("_nth", F.row_number().over(order) - 1)
    # The map has one row a slot, n_slots at most.
    return inside.join(F.broadcast(current), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard",
        (F.col("_nth") + F.col("before")).cast("long").alias("position"), "map_version")
