"""Operational tables with fixed schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema as S


class SchemaMismatch(ValueError):
    """A table lacks required columns."""


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan with a declared schema: no inference pass over the files."""
    return spark.read.schema(schema).parquet(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Required columns in order; known nullable additions are filled in, idempotently."""
    required, optional = S.REQUIRED[table]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaMismatch(f"{table} lacks {', '.join(missing)}")
    added = {name: F.lit(None).cast(dtype) for name, dtype in optional if name not in df.columns}
    return df.withColumns(added).select(*required, *[name for name, _ in optional]) if added else (
        df.select(*required, *[name for name, _ in optional]))


def union_versions(frames: list[DataFrame], table: str) -> DataFrame:
    """Old and new files of one table together."""
    return reduce(lambda a, b: a.unionByName(b), [conform(f, table) for f in frames])
