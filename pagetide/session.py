"""Session settings the library is designed for."""

from __future__ import annotations

import functools
import glob
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pagetide", master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC.

    Shuffle width is left to the caller (``spark.sql.shuffle.partitions``); AQE
    coalesces it downwards, so a cluster should set it high.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, so they need no copy installed. Once per session."""
    context = spark.sparkContext
    if getattr(context, "_pagetide_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ship-")
    archive = os.path.join(folder, "pagetide-src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(glob.glob(f"{root}/**/*.py", recursive=True)):
            out.write(path, os.path.join("pagetide", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._pagetide_shipped = True


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate state.

    A cluster names it in ``spark.checkpoint.dir``; only a local session, whose driver and
    executor are one process, may do without and gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_root()


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return found.exists(where) and found.getFileStatus(where).isDirectory()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an expensive intermediate result to the shared folder and read it back.

    Later jobs read the files, so they neither repeat the work nor depend on the
    executors that did it. Remove it with ``discard`` when nothing reads it any more.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``store``."""
    spark, path = df.sparkSession, df._stored_at
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
