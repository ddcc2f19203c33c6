"""Document and image metadata: inspect, patch, before/after reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.values import blank_to_null

# Metadata fields.
INFO_FIELDS = ("title", "author", "subject", "keywords", "creator", "producer")
DATE_FIELDS = ("creation_date", "modification_date")
WRITABLE_FIELDS = ("title", "author", "subject", "keywords")
VALUE_MAX_CHARS = 200


def inspect(info: DataFrame) -> DataFrame:
    """Clean info fields; a locked document shows nothing but that it is locked."""
    open_doc = ~F.col("encrypted")
    return info.select(
        "file_id", *[F.when(open_doc, blank_to_null(F.col(f))).alias(f) for f in INFO_FIELDS],
        F.when(open_doc, F.col("page_count")).alias("page_count"), "encrypted",
        F.when(open_doc, F.col("has_forms")).alias("has_forms"))


def as_json(df: DataFrame, key: str = "file_id") -> DataFrame:
    """One JSON record per row; empty fields are kept as null."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def write_json_report(df: DataFrame, path: str) -> None:
    """JSON lines, in parallel, with explicit nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def patch(info: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits: null leaves a field, '' clears it. ``edits(file_id, title, ...)``.

    No supplied field gives ``missing_option``; a locked document gives ``encrypted_input``.
    """
    renamed = edits.select("file_id", *[F.col(f).alias(f"_{f}") for f in WRITABLE_FIELDS], F.lit(True).alias("_e"))
    joined = info.join(renamed, "file_id", "left")
    nothing = F.coalesce(*[F.col(f"_{f}") for f in WRITABLE_FIELDS]).isNull()
    code = F.when(F.col("_e").isNull(), F.lit(None).cast("string")).when(nothing, S.MISSING_OPTION).when(
        F.col("encrypted"), "encrypted_input")
    coded = joined.withColumn("error_code", code)

    def patched(f: str) -> Column:
        change = F.col("error_code").isNull() & F.col(f"_{f}").isNotNull()
        return F.when(change, F.nullif(F.col(f"_{f}"), F.lit(""))).otherwise(F.col(f)).alias(f)

    return coded.select("file_id", *[patched(f) for f in WRITABLE_FIELDS], "error_code")


def _facts(row: dict[str, Column]) -> Column:
    """Map of the fields that count as present: not null, '', false or 0."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in row.items()]
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "false", "0"))
    return F.map_from_entries(kept)


def strip_report(info: DataFrame, producer_after: str = "writer") -> DataFrame:
    """What stripping removes and what stays.

    Stripping blanks every info field; the writer leaves its own producer, the page
    count stays, and the XMP flag turns false. A false flag is not an empty value,
    so the XMP packet is never listed as removed (compatible behaviour).
    """
    fields = (*INFO_FIELDS, *DATE_FIELDS)
    before = {f: blank_to_null(F.col(f)) for f in fields}
    none = F.lit(None).cast("string")
    after = {f: F.lit(producer_after) if f == "producer" else none for f in fields}
    facts_before = _facts({**before, "page_count": F.col("page_count"), "has_xmp_metadata": F.col("has_xmp")})
    facts_after = _facts({**after, "page_count": F.col("page_count"), "has_xmp_metadata": F.lit(False)})
    gone = F.array(*[F.lit(f) for f in fields if f != "producer"])
    removed = F.array_sort(F.array_intersect(F.map_keys(facts_before), gone))
    remaining = F.array_sort(F.map_keys(facts_after))
    note = F.when(F.array_contains(remaining, "producer"), "producer is set by the writer").otherwise("")
    return info.select("file_id", facts_before.alias("before"), facts_after.alias("after"),
                       removed.alias("removed"), remaining.alias("remaining"), note.alias("note"))


def report_from_pairs(pairs: DataFrame) -> DataFrame:
    """The same report from long ``(file_id, phase, key, value)`` rows of two real reads."""
    full = F.col("value").isNotNull() & ~F.col("value").isin("", "false", "0")
    # Flags only: a text as the buffer of a group would have every row sorted before it is grouped.
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    keyed = pairs.groupBy("file_id", "key").agg(
        F.bool_or((F.col("phase") == "before") & full).alias("_before"),
        F.bool_or((F.col("phase") == "after") & full).alias("_after"),
        F.coalesce(F.bool_or((F.col("phase") == "after") & filled), F.lit(False)).alias("_text"))
    return keyed.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_before") & ~F.col("_text"), F.col("key")))).alias("removed"),
        F.array_sort(F.collect_list(F.when(F.col("_after"), F.col("key")))).alias("remaining"))


def image_report(images: DataFrame) -> DataFrame:
    """Image tags before stripping: all are removed; values are cut for display."""
    shown = F.transform_values("tags", lambda k, v: F.left(v, F.lit(VALUE_MAX_CHARS)))
    return images.select("file_id", shown.alias("before"), F.array_sort(F.map_keys("tags")).alias("removed"))
