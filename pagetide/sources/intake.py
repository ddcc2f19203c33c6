"""File intake, upload parts and content-addressed storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import values as V


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder as (filename, content, size_bytes, mime).

    Spark's file scan leaves out files of zero bytes; an upload feed that must report
    them has to pass its rows to :func:`intake` itself.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern) \
        .option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content",
                      F.col("length").alias("size_bytes"), F.lit("").alias("mime"))


def intake(uploads: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hash, size, kind, storage key and verdict per upload.

    Needs filename, mime, content and size_bytes. A damaged or locked document
    passes with an unknown page count, so that repair and unlock can see it.
    """
    ext = V.extension(F.col("filename"), F.col("mime"))
    sha = F.sha2(F.col("content").cast("binary"), 256)
    head = F.col("content").cast("binary").substr(1, 5).cast("string")
    code = V.intake_code(F.col("size_bytes"), head, F.col("filename"), F.col("mime"), max_bytes)
    kind = V.media_kind(F.col("filename"), F.col("mime"))
    rest = [c for c in uploads.columns if c not in ("content", "mime")]
    return uploads.select(
        *rest, sha.alias("sha256"),
        F.when(kind == "pdf", V.PDF_MIME).otherwise(F.col("mime")).alias("mime"),
        V.storage_key(sha, ext).alias("storage_key"),
        code.alias("reject_code"),
        F.when(code.isNull(), "validated").otherwise("rejected").alias("status"),
    )


def within(size: Column, most: int | None) -> Column:
    """Sizes above 0, and up to ``most`` if there is a bound."""
    return size >= 1 if most is None else size.between(1, most)


def assemble_parts(uploads: DataFrame, parts: DataFrame, part_bytes: int = S.PART_BYTES,
                   max_bytes: int | None = None) -> DataFrame:
    """Reassemble uploads from parts that came in any order, some more than once.

    A re-sent part replaces the earlier one; that is settled by a partial aggregate
    before the upload is put together. An accepted upload has a bounded number of
    parts, and parts outside the declared count are dropped before the group.
    """
    over = F.lit(False) if max_bytes is None else F.col("declared_size") > max_bytes
    n_parts = F.ceil(F.col("declared_size") / F.lit(part_bytes)).cast("int")
    newest = parts.groupBy("upload_id", "idx").agg(F.max_by("bytes", "ts").alias("bytes"))
    declared = uploads.withColumn("n_parts", n_parts)
    usable = declared.filter(within(F.col("declared_size"), max_bytes)).select("upload_id", "n_parts", "declared_size")
    last = F.col("declared_size") - F.lit(part_bytes) * (F.col("n_parts") - 1)
    expected = F.when(F.col("idx") < F.col("n_parts") - 1, F.lit(part_bytes)).otherwise(last)
    kept = newest.join(usable, "upload_id").filter(F.col("idx").between(0, F.col("n_parts") - 1))
    wrong = F.length("bytes") != expected
    joined = kept.groupBy("upload_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "bytes"))).alias("_parts"),
        F.count(F.lit(1)).alias("_have"),
        F.min(F.when(wrong, F.col("idx"))).alias("_wrong"),
    )
    kind = dict(parts.dtypes)["bytes"]
    data = F.aggregate("_parts", F.lit("").cast(kind), lambda acc, p: F.concat(acc, p["bytes"]))
    # first index that is not there: the sorted parts agree with 0, 1, 2, ... up to it
    gaps = F.filter(F.transform("_parts", lambda p, i: F.when(p["idx"] != i, i)), lambda i: i.isNotNull())
    missing = F.when(F.col("_have") < F.col("n_parts"), F.coalesce(F.get(gaps, F.lit(0)), F.col("_have").cast("int")))
    code = (
        F.when(over, S.FILE_TOO_LARGE)
        .when(F.col("declared_size") <= 0, "empty_file")
        .when(F.col("_have").isNull(), "missing_part")
        .when(missing.isNotNull() & (F.col("_wrong").isNull() | (missing < F.col("_wrong"))), "missing_part")
        .when(F.col("_wrong").isNotNull(), "wrong_part_size")
    )
    return declared.join(joined, "upload_id", "left").select(
        *uploads.columns, "n_parts", code.alias("reject_code"),
        F.when(code.isNull(), data).alias("data"),
    )


def objects_to_write(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per new storage key that is not stored yet."""
    fresh = incoming.groupBy("storage_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    return fresh.join(existing.select("storage_key").distinct(), "storage_key", "left_anti")


def unreferenced_objects(objects: DataFrame, files: DataFrame) -> DataFrame:
    """Stored objects that no file row refers to any more."""
    return objects.select("storage_key").distinct().join(
        files.select("storage_key").distinct(), "storage_key", "left_anti")


def dedup_stats(files: DataFrame) -> DataFrame:
    """How much content addressing saves. Copies of one object are counted map-side."""
    per_object = files.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("copies"), F.max("size_bytes").alias("size"))
    return per_object.agg(
        F.sum("copies").alias("files"), F.count(F.lit(1)).alias("objects"),
        F.sum((F.col("copies") - 1) * F.col("size")).alias("bytes_saved"))


def pick_smallest(attempts: DataFrame, files: DataFrame) -> DataFrame:
    """Best rebuild per file: attempt 0, then the original, then the levels in order.

    ``attempts(file_id, attempt_no, size)``; ``files(file_id, original, target)``.
    The first attempt under the target is also the first running best under it, so
    plain aggregates with map-side combine are enough.
    """
    fits = F.when(F.col("size") <= F.col("target"), F.col("attempt_no"))
    best = attempts.join(files, "file_id").groupBy("file_id", "original", "target").agg(
        F.min(fits).alias("_first"), F.min_by("size", fits).alias("_first_size"),
        F.min_by("size", "attempt_no").alias("_rebuild"),
        F.min(F.struct("size", "attempt_no")).alias("_least"),
    )
    original_wins = (F.col("original") <= F.col("target")) & (F.col("original") < F.col("_rebuild"))
    choice = (
        F.when(F.col("_first") == 0, F.struct(F.lit("rebuild").alias("choice"), F.col("_first_size").alias("best_size")))
        .when(original_wins, F.struct(F.lit("original").alias("choice"), F.col("original").alias("best_size")))
        .when(F.col("_first").isNotNull(), F.struct(
            F.concat(F.lit("level "), F.col("_first")).alias("choice"), F.col("_first_size").alias("best_size")))
        .otherwise(F.struct(
            F.when(F.col("_least.attempt_no") == 0, "rebuild")
            .otherwise(F.concat(F.lit("level "), F.col("_least.attempt_no"))).alias("choice"),
            F.col("_least.size").alias("best_size")))
    )
    return best.withColumn("_c", choice).select(
        "file_id", "original", "target", F.col("_c.choice").alias("choice"),
        F.col("_c.best_size").alias("best_size"), (F.col("_c.best_size") <= F.col("target")).alias("met"))


# Texts of the report.
TARGET_MET, TARGET_MISSED = "OK — target met", "TARGET MISSED — smallest version possible"


def size_report(picked: DataFrame) -> DataFrame:
    def mb(c: str) -> Column:
        return F.format_string("%.2f MB", F.col(c) / F.lit(1048576.0))

    status = F.when(F.col("met"), TARGET_MET).otherwise(TARGET_MISSED)
    return picked.select("file_id", "original", "best_size", "met", status.alias("status"),
                         F.concat_ws(" -> ", mb("original"), mb("best_size")).alias("sizes"))
