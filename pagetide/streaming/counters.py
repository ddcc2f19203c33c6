"""Tumbling counters with event-time watermarks, kept as tables of their current values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions import values as V
from .tables import BatchTable


def hourly_usage(attempts: DataFrame) -> DataFrame:
    """Successes per (ip, tool, calendar hour); state is dropped two hours behind."""
    return (
        attempts.filter("succeeded").withColumn("ts", V.utc_instant(F.col("ts")))
        .withWatermark("ts", f"{S.QUOTA_RETENTION_HOURS} hours")
        .groupBy("ip", "tool", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("used"))
        .select("ip", "tool", V.utc_wall(F.col("w.start")).alias("window_start"), "used")
    )


def daily_counts(visits: DataFrame, *dimensions: str) -> DataFrame:
    """Visits per UTC day (and dimension); state is dropped after the retention time."""
    return (
        visits.withColumn("created_at", V.utc_instant(F.col("created_at")))
        .withWatermark("created_at", f"{S.RETENTION_DAYS} days")
        .groupBy(F.window("created_at", "1 day").alias("w"), *dimensions).agg(F.count(F.lit(1)).alias("count"))
        .select(V.day(V.utc_wall(F.col("w.start"))).alias("date"), *dimensions, "count")
    )


def counter_table(spark: SparkSession, out: str, keys: list[str], at: str, retention_days: int | None = None) -> BatchTable:
    """The table of current values; ``at`` is the key column that holds the counter's time."""
    return BatchTable(spark, out, "_at", [*keys, "_at"], retention_days)


def start_upserts(counts: DataFrame, out: str, checkpoint: str, keys: list[str], at: str,
                  available_now: bool = False, retention_days: int | None = None,
                  top: tuple[str, int] | None = None) -> StreamingQuery:
    """Merge the changed counters of each micro-batch into a table under ``out``. With ``top`` =
    (value column, k), the k largest of each day that changed are kept in a second table beside it."""
    spark = counts.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        timed = batch.withColumn("_at", F.col(at).cast("timestamp_ntz")).persist()
        try:
            newest = timed.agg(F.max("_at")).first()[0]
            table = counter_table(session, f"{out}/counts", keys, at, retention_days)
            table.commit(timed, batch_id, newest, checkpoint)
            if top is not None:
                days = [r[0] for r in timed.select(F.date_format("_at", "yyyy-MM-dd")).distinct().collect()]
                best = largest(table.read(days).withColumn("_at", F.date_trunc("day", "_at").cast("timestamp_ntz")),
                               keys, at, *top)
                top_table(session, out, retention_days).commit(best, batch_id, newest, checkpoint)
        finally:
            timed.unpersist()

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def largest(counts: DataFrame, keys: list[str], at: str, value: str, k: int) -> DataFrame:
    """The k largest counters per time; equal ones by their keys."""
    rest = [c for c in keys if c != at]
    order = Window.partitionBy("_at").orderBy(F.desc(value), *[F.asc_nulls_first(c) for c in rest])
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_table(spark: SparkSession, out: str, retention_days: int | None = None) -> BatchTable:
    return BatchTable(spark, f"{out}/top", "_at", ["_at", "rank"], retention_days)


def current_top(spark: SparkSession, out: str, retention_days: int | None = None) -> DataFrame:
    return top_table(spark, out, retention_days).read().drop("_at")


def current_counts(spark: SparkSession, out: str, keys: list[str], at: str, retention_days: int | None = None) -> DataFrame:
    """Latest value per key."""
    return counter_table(spark, f"{out}/counts", keys, at, retention_days).read().drop("_at")
