"""Continuous classification of page requests into visit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import traffic as T
from ..session import is_folder
from .tables import BatchTable


def read_requests(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                  files_per_trigger: int | None = None) -> DataFrame:
    """Request logs as a stream with a declared schema. ``pattern`` names the file in ``folder`` or,
    as tables usually are, the folder of part files; both are read."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, f"{folder}/{pattern}"):
        return reader.parquet(f"{folder}/{pattern}")
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def visit_table(spark: SparkSession, out: str, name: str, retention_days: int | None = None) -> BatchTable:
    """``visits`` or ``bot_visits`` under ``out``; visits keep one row an identifier."""
    return BatchTable(spark, f"{out}/{name}", "created_at", ["id"], retention_days)


def start_visit_stream(requests: DataFrame, blocks: DataFrame, out: str, checkpoint: str,
                       available_now: bool = False, retention_days: int | None = None,
                       path_chars: int | None = None) -> StreamingQuery:
    """Classify and route every micro-batch: humans to ``visits``, bots to ``bot_visits``. The batch
    is located once and kept for both.

    A batch that is run again finds itself committed; what a stream with a new checkpoint reads
    again is kept once, by identifier. ``retention_days`` counts from the newest
    request seen; older rows are not read any more and their days are removed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        located = T.geo_lookup(T.tracked_requests(batch), blocks).persist()
        try:
            newest = batch.agg(F.max("ts")).first()[0]
            for name, rows in (("visits", T.to_visits(located, path_chars)), ("bot_visits", T.to_bot_visits(located, path_chars))):
                visit_table(session, out, name, retention_days).commit(rows, batch_id, newest, checkpoint)
        finally:
            located.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def read_table(spark: SparkSession, out: str, name: str, retention_days: int | None = None) -> DataFrame:
    return visit_table(spark, out, name, retention_days).read()
