"""Queries over files, upload parts and stored objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import values as V
from ..operators import usage as U
from ..operators.catalog import tool_catalog, tool_options
from ..operators.catalog import TOOLS, TOOL_OPTIONS
from ..sources import intake as I
from ..sources.tables import conform, union_versions
from .inputs import cte, derived, source
from .registry import query

PART = 8192
_EXT = """CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '([^.]*)$', 1)) WHEN mime = 'application/pdf' THEN 'pdf'
  WHEN mime = 'image/png' THEN 'png' WHEN mime = 'image/jpeg' THEN 'jpg' ELSE 'bin' END"""
_KIND = """CASE WHEN lower(mime) = 'application/pdf' OR lower(filename) LIKE '%.pdf' THEN 'pdf'
  WHEN lower(mime) IN ('image/png', 'image/jpeg', 'image/webp') OR regexp_matches(lower(filename), '[.](png|jpg|jpeg|webp)$') THEN 'image' ELSE 'other' END"""
FILES = cte("files", stored=f"SELECT *, sha256(content) AS sha256, sha256(content) || '.' || {_EXT} AS storage_key FROM files")


def stored_files(spark, sf):
    ext = V.extension(F.col("filename"), F.col("mime"))
    sha = F.sha2("content", 256)
    return derived(spark, sf, "files").withColumns({"sha256": sha, "storage_key": V.storage_key(sha, ext)})


@query("src_tables", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def src_tables(spark, sf):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    from ..sources.tables import read_table

    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
                         StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType())])
    return read_table(spark, f"{sf}/orders.parquet", schema)


@query("src_conform", cte("jobs") + """SELECT id, tool, status, 'new' AS version, CASE WHEN status = 'failed' THEN 'internal_error' END AS error_code FROM jobs WHERE status <> 'succeeded'
  UNION ALL SELECT id, tool, status, 'old', NULL FROM jobs WHERE status = 'succeeded'""")
def src_conform(spark, sf):
    none = F.lit(None).cast("string")
    jobs = derived(spark, sf, "jobs").withColumns({"file_ids": none, "output_file_id": none, "updated_at": F.col("created_at")})
    old = jobs.filter("status = 'succeeded'")
    new = jobs.filter("status <> 'succeeded'").withColumn("error_code", F.when(F.col("status") == "failed", "internal_error"))
    both = union_versions([old, conform(new, "jobs")], "jobs")
    return both.select("id", "tool", "status", F.when(F.col("status") == "succeeded", "old").otherwise("new").alias("version"), "error_code")


@query("src_binary", cte("files") + f"""SELECT id, filename, sha256(content) AS sha256, strlen(content) AS size_bytes, sha256(content) || '.' || {_EXT} AS storage_key,
  CASE WHEN strlen(content) > 20000 THEN 'file_too_large' WHEN {_KIND} = 'pdf' THEN 'not_a_pdf' WHEN {_KIND} = 'other' THEN 'unsupported_type' END AS reject_code FROM files""")
def src_binary(spark, sf):
    raw = derived(spark, sf, "files").select(
        "id", "filename", "mime", F.encode("content", "UTF-8").alias("content"))
    uploads = raw.withColumn("size_bytes", F.octet_length("content").cast("long"))
    return I.intake(uploads, max_bytes=20000).select(
        "id", "filename", "sha256", "size_bytes", "storage_key", "reject_code")


_CATALOG = ", ".join(f"('{k}', '{c}', {lo}, {hi})" for k, c, _, lo, hi, _ in TOOLS)
_OPTS = ", ".join(f"('{t}', '{n}')" for t, n, *_ in TOOL_OPTIONS)


@query("src_catalog", cte("jobs") + f"""SELECT t.key, t.category, o.option, count(j.id) AS jobs FROM (VALUES {_CATALOG}) t(key, category, lo, hi)
  LEFT JOIN (VALUES {_OPTS}) o(tool, option) ON o.tool = t.key LEFT JOIN jobs j ON j.tool = t.key GROUP BY ALL""")
def src_catalog(spark, sf):
    catalog = tool_catalog(spark)
    used = derived(spark, sf, "jobs").groupBy(F.col("tool").alias("key")).agg(F.count("*").alias("jobs"))
    options = tool_options(catalog).join(catalog.select("key", "category"), "key")
    return options.join(used, "key", "left").fillna(0, ["jobs"]).select("key", "category", "option", "jobs")


_SENT = f"""SELECT doc_id AS upload_id, idx, CASE WHEN doc_id % 11 = 5 AND idx = n // 2 THEN substr(piece, 2) ELSE piece END AS piece,
  TIMESTAMP '2024-01-01 00:00:00' + (doc_id * 37 + idx * 60) * INTERVAL '1' SECOND AS ts FROM
  (SELECT doc_id, n, unnest(range(n)) AS idx, substr(text, (unnest(range(n)) * {PART} + 1)::BIGINT, {PART}) AS piece
   FROM (SELECT doc_id, text, (length(text) + {PART} - 1) // {PART} AS n FROM documents)) WHERE NOT (doc_id % 9 = 3 AND idx = n - 1)"""


def sent_parts(spark, sf):
    """Documents cut into parts; some lose their last part, some have a short part, all
    are sent twice (an older empty copy first)."""
    n = F.ceil(F.length("text") / F.lit(PART)).cast("int")
    docs = source(spark, sf, "documents").select(F.col("doc_id").alias("upload_id"), "text", n.alias("n"))
    cut = docs.filter("n > 0").withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    piece = F.substring(F.col("text"), F.col("idx") * PART + 1, F.lit(PART))
    short = F.when((F.col("upload_id") % 11 == 5) & (F.col("idx") == F.floor(F.col("n") / 2)), F.substring(piece, 2, PART)).otherwise(piece)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = start + F.make_dt_interval(secs=F.col("upload_id") * 37 + F.col("idx") * 60)
    sent = cut.filter(~((F.col("upload_id") % 9 == 3) & (F.col("idx") == F.col("n") - 1))).select(
        "upload_id", "idx", short.alias("bytes"), ts.alias("ts"))
    older = sent.withColumns({"bytes": F.lit(""), "ts": F.col("ts") - F.expr("INTERVAL '1' HOUR")})
    return sent.unionByName(older)


@query("src_parts", f"""WITH sent AS ({_SENT}), up AS (SELECT doc_id AS upload_id, length(text) AS size, (length(text) + {PART} - 1) // {PART} AS n FROM documents),
  wanted AS (SELECT upload_id, size, n, unnest(range(n)) AS idx FROM up),
  seen AS (SELECT w.*, s.piece, CASE WHEN s.idx IS NULL THEN 'missing_part' WHEN length(s.piece) <> CASE WHEN w.idx < n - 1 THEN {PART} ELSE size - {PART} * (n - 1) END THEN 'wrong_part_size' END AS problem
    FROM wanted w LEFT JOIN sent s ON s.upload_id = w.upload_id AND s.idx = w.idx)
  SELECT up.upload_id, up.n AS n_parts, CASE WHEN up.size = 0 THEN 'empty_file' ELSE p.code END AS reject_code,
   CASE WHEN p.code IS NULL AND up.size > 0 THEN sha256(d.text) END AS sha256
  FROM up JOIN documents d ON d.doc_id = up.upload_id LEFT JOIN (SELECT upload_id, arg_min(problem, idx) FILTER (problem IS NOT NULL) AS code FROM seen GROUP BY 1) p ON p.upload_id = up.upload_id""")
def src_parts(spark, sf):
    uploads = source(spark, sf, "documents").select(
        F.col("doc_id").alias("upload_id"), F.length("text").cast("long").alias("declared_size"))
    done = I.assemble_parts(uploads, sent_parts(spark, sf), part_bytes=PART, max_bytes=S.MAX_UPLOAD_BYTES)
    return done.select("upload_id", "n_parts", "reject_code", F.sha2("data", 256).alias("sha256"))


@query("src_stale_parts", f"""WITH sent AS ({_SENT}) SELECT upload_id, max(ts) AS touched_at FROM sent GROUP BY 1
  HAVING max(ts) < TIMESTAMP '2024-01-01 08:00:00' - INTERVAL 2 HOUR""")
def src_stale_parts(spark, sf):
    return U.stale_uploads(sent_parts(spark, sf), "2024-01-01 08:00:00")


@query("f_intake", cte("files") + f"""SELECT id, CASE WHEN size_bytes > 52428800 THEN 'file_too_large' WHEN size_bytes = 0 THEN 'empty_file'
  WHEN {_KIND} = 'pdf' AND NOT starts_with(head, '%PDF-') THEN 'not_a_pdf' WHEN {_KIND} = 'other' THEN 'unsupported_type' END AS reject_code FROM files""")
def f_intake(spark, sf):
    return derived(spark, sf, "files").select("id", V.intake_code(
        F.col("size_bytes"), F.col("head"), F.col("filename"), F.col("mime"), S.MAX_UPLOAD_BYTES).alias("reject_code"))


@query("s_ext", cte("files") + f"SELECT id, left({_EXT}, 10) AS ext FROM files")
def s_ext(spark, sf):
    return derived(spark, sf, "files").select("id", V.extension(F.col("filename"), F.col("mime")).alias("ext"))


@query("s_kind", cte("files") + f"SELECT id, {_KIND} AS kind FROM files")
def s_kind(spark, sf):
    return derived(spark, sf, "files").select("id", V.media_kind(F.col("filename"), F.col("mime")).alias("kind"))


@query("snk_dedup_put", FILES + """SELECT storage_key, min(id) AS id, count(*) AS copies FROM stored WHERE status = 'validated'
  AND storage_key NOT IN (SELECT storage_key FROM stored WHERE status = 'rejected') GROUP BY 1""")
def snk_dedup_put(spark, sf):
    files = stored_files(spark, sf)
    return I.objects_to_write(files.filter("status = 'validated'"), files.filter("status = 'rejected'"))


@query("j_unreferenced", FILES + """SELECT DISTINCT storage_key FROM stored
  WHERE storage_key NOT IN (SELECT storage_key FROM stored WHERE status = 'validated')""")
def j_unreferenced(spark, sf):
    files = stored_files(spark, sf)
    return I.unreferenced_objects(files, files.filter("status = 'validated'"))


@query("a_dedup_stats", """SELECT count(*) AS files, count(DISTINCT text) AS objects,
  sum(strlen(text)) - (SELECT sum(strlen(text)) FROM (SELECT DISTINCT text FROM documents)) AS bytes_saved FROM documents""")
def a_dedup_stats(spark, sf):
    files = source(spark, sf, "documents").select(
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
    return I.dedup_stats(files)


_ATT = """att AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS attempt_no,
    CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem),
  f AS (SELECT o_orderkey AS file_id, CAST(floor(o_totalprice / 6) AS BIGINT) AS original, 20000 + (o_orderkey % 5) * 10000 AS target FROM orders)"""
_PICK = f"""WITH {_ATT}, running AS (SELECT a.*, original, target, min(size) OVER (PARTITION BY file_id ORDER BY attempt_no) AS best FROM att a JOIN f USING (file_id)),
  state AS (SELECT file_id, original, target, arg_min(size, attempt_no) AS rebuild, min(attempt_no) FILTER (best <= target) AS first_ok,
    arg_min(best, attempt_no) FILTER (best <= target) AS first_size, min(size) AS least, arg_min(attempt_no, (size, attempt_no)) AS least_no FROM running GROUP BY ALL),
  picked AS (SELECT file_id, original, target, CASE WHEN rebuild <= target THEN 'rebuild' WHEN original <= target AND original < rebuild THEN 'original'
    WHEN first_ok IS NOT NULL THEN 'level ' || first_ok WHEN least_no = 0 THEN 'rebuild' ELSE 'level ' || least_no END AS choice,
    CASE WHEN rebuild <= target THEN rebuild WHEN original <= target AND original < rebuild THEN original
    WHEN first_ok IS NOT NULL THEN first_size ELSE least END AS best_size FROM state) """


def picked_sizes(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    attempts = source(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.row_number().over(order) - 1).alias("attempt_no"),
        F.floor("l_extendedprice").alias("size"))
    files = source(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.floor(F.col("o_totalprice") / 6).alias("original"),
        (20000 + F.col("o_orderkey") % 5 * 10000).alias("target"))
    return I.pick_smallest(attempts, files)


@query("w_pick_smallest", _PICK + "SELECT *, best_size <= target AS met FROM picked")
def w_pick_smallest(spark, sf):
    return picked_sizes(spark, sf)


@query("a_size_report", _PICK + """SELECT file_id, original, best_size, best_size <= target AS met,
  CASE WHEN best_size <= target THEN 'OK — target met' ELSE 'TARGET MISSED — smallest version possible' END AS status FROM picked""")
def a_size_report(spark, sf):
    return I.size_report(picked_sizes(spark, sf)).drop("sizes")
