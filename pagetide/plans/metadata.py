"""Queries over document metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import metadata as M
from .inputs import cte, derived
from .registry import query

_CLEAN = r"nullif(regexp_replace({}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'), '')"
INFO = cte("attributes")
_FIELDS = ", ".join(f"CASE WHEN NOT encrypted THEN {_CLEAN.format(f)} END AS {f}" for f in M.INFO_FIELDS)
_INSPECT = f"SELECT file_id, {_FIELDS}, CASE WHEN NOT encrypted THEN page_count END AS page_count, encrypted, CASE WHEN NOT encrypted THEN has_forms END AS has_forms FROM attributes"


@query("s_blank_null", INFO + f"SELECT file_id, {_CLEAN.format('title')} AS title, {_CLEAN.format('author')} AS author FROM attributes")
def s_blank_null(spark, sf):
    return derived(spark, sf, "attributes").select(
        "file_id", *[V.blank_to_null(F.col(f)).alias(f) for f in ("title", "author")])


@query("m_inspect", INFO + _INSPECT)
def m_inspect(spark, sf):
    return M.inspect(derived(spark, sf, "attributes"))


@query("snk_json", INFO + f"SELECT file_id, to_json(struct_pack(title := title, author := author, subject := subject, keywords := keywords, creator := creator, producer := producer, page_count := page_count, encrypted := encrypted, has_forms := has_forms))::VARCHAR AS json FROM ({_INSPECT})")
def snk_json(spark, sf):
    return M.as_json(M.inspect(derived(spark, sf, "attributes")))


_EDIT = """SELECT file_id, CASE WHEN file_id % 4 = 0 THEN concat('New ', file_id) WHEN file_id % 4 = 1 THEN '' END AS title,
  CASE WHEN file_id % 5 = 0 THEN 'Someone' END AS author, CASE WHEN file_id % 6 = 0 THEN '' END AS subject, CAST(NULL AS STRING) AS keywords FROM attributes WHERE page_count > 3"""


@query("m_edit", INFO + f""", edits AS ({_EDIT}), j AS (SELECT a.*, e.file_id AS eid, e.title AS t, e.author AS au, e.subject AS su, e.keywords AS k, CASE WHEN e.file_id IS NULL THEN NULL
    WHEN e.title IS NULL AND e.author IS NULL AND e.subject IS NULL AND e.keywords IS NULL THEN 'missing_option' WHEN encrypted THEN 'encrypted_input' END AS error_code FROM attributes a LEFT JOIN edits e ON e.file_id = a.file_id)
  SELECT file_id, CASE WHEN error_code IS NULL AND t IS NOT NULL THEN nullif(t, '') ELSE title END AS title, CASE WHEN error_code IS NULL AND au IS NOT NULL THEN nullif(au, '') ELSE author END AS author,
  CASE WHEN error_code IS NULL AND su IS NOT NULL THEN nullif(su, '') ELSE subject END AS subject, CASE WHEN error_code IS NULL AND k IS NOT NULL THEN nullif(k, '') ELSE keywords END AS keywords, error_code FROM j""")
def m_edit(spark, sf):
    info = derived(spark, sf, "attributes")
    edits = info.filter("page_count > 3").selectExpr(
        "file_id", "CASE WHEN file_id % 4 = 0 THEN concat('New ', file_id) WHEN file_id % 4 = 1 THEN '' END AS title",
        "CASE WHEN file_id % 5 = 0 THEN 'Someone' END AS author", "CASE WHEN file_id % 6 = 0 THEN '' END AS subject",
        "CAST(NULL AS STRING) AS keywords")
    return M.patch(info, edits)


_REMOVED = ", ".join(f"CASE WHEN {_CLEAN.format(f)} IS NOT NULL THEN '{f}' END" for f in sorted((*M.INFO_FIELDS, *M.DATE_FIELDS)) if f != "producer")


@query("m_strip_report", INFO + f"""SELECT file_id, concat_ws(',', {_REMOVED}) AS removed, concat_ws(',', CASE WHEN page_count > 0 THEN 'page_count' END, 'producer') AS remaining,
  (SELECT count(x) FROM (VALUES {", ".join(f"({_CLEAN.format(f)})" for f in (*M.INFO_FIELDS, *M.DATE_FIELDS))}) v(x)) + (page_count > 0)::INT + has_xmp::INT AS fields_before FROM attributes""")
def m_strip_report(spark, sf):
    return M.strip_report(derived(spark, sf, "attributes")).select(
        "file_id", F.array_join("removed", ",").alias("removed"), F.array_join("remaining", ",").alias("remaining"),
        F.size("before").alias("fields_before"))


@query("m_strip_pairs", INFO + f"""SELECT file_id, concat_ws(',', {_REMOVED}) AS removed, concat_ws(',', CASE WHEN page_count > 0 THEN 'page_count' END, 'producer') AS remaining FROM attributes""")
def m_strip_pairs(spark, sf):
    """The report built from long before/after rows. One file becomes 20 rows, so files are dealt
    over the whole shuffle width before, and stay where they are."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    info, fields = derived(spark, sf, "attributes").repartition(width, "file_id"), (*M.INFO_FIELDS, *M.DATE_FIELDS)
    pair = lambda phase, key, value: F.struct(
        F.lit(phase).alias("phase"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    before = [pair("before", f, V.blank_to_null(F.col(f))) for f in fields]
    after = [pair("after", f, F.lit("writer" if f == "producer" else None)) for f in fields]
    both = [pair(p, "page_count", F.col("page_count")) for p in ("before", "after")]
    xmp = [pair("before", "has_xmp_metadata", F.col("has_xmp")), pair("after", "has_xmp_metadata", F.lit(False))]
    rows = info.select("file_id", F.explode(F.array(*before, *after, *both, *xmp)).alias("p")).select("file_id", "p.*")
    return M.report_from_pairs(rows).select(
        "file_id", F.array_join("removed", ",").alias("removed"), F.array_join("remaining", ",").alias("remaining"))


@query("m_image_report", """SELECT doc_id AS file_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'Artist' END, 'ImageDescription', 'Software') AS removed, left(text, 200) AS description FROM documents""")
def m_image_report(spark, sf):
    from .inputs import source

    tags = F.map_filter(F.create_map(
        F.lit("Software"), F.col("source"), F.lit("ImageDescription"), F.col("text"),
        F.lit("Artist"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), lambda k, v: v.isNotNull())
    images = source(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), tags.alias("tags"))
    report = M.image_report(images)
    return report.select("file_id", F.array_join("removed", ",").alias("removed"),
                         F.col("before")["ImageDescription"].alias("description"))
