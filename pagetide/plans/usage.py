"""Queries over jobs, quotas, logins and duplicate submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import values as V
from ..operators import usage as U
from ..operators.catalog import TOOLS, tool_catalog
from .inputs import cte, derived, source
from .registry import query

JOBS = cte("jobs", "files")
_FILE_IDS = ("SELECT l_orderkey, '[' || string_agg('\"' || l_partkey || '\"', ',' ORDER BY l_linenumber, l_partkey) || ']' AS file_ids "
             "FROM lineitem GROUP BY 1")
JOB_FILES = cte("jobs", "files", jf=f"SELECT j.*, f.file_ids FROM jobs j JOIN ({_FILE_IDS}) f ON j.id = CAST(f.l_orderkey AS VARCHAR)",
                exploded="""SELECT id, tool, unnest(from_json(file_ids, '["VARCHAR"]')) AS file_id,
                  generate_subscripts(from_json(file_ids, '["VARCHAR"]'), 1) AS pos FROM jf""")


def jobs_with_inputs(spark, sf):
    """Jobs with the JSON list of their ordered inputs."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lists = source(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.to_json(F.transform(items, lambda s: s["l_partkey"].cast("string"))).alias("file_ids"))
    return derived(spark, sf, "jobs").join(lists, "id")


@query("f_status", JOBS + """SELECT 'open' AS filter, id, status FROM jobs WHERE status = 'queued' OR status = 'running'
  UNION ALL SELECT 'failed', id, status FROM jobs WHERE status = 'failed' UNION ALL SELECT 'any', id, status FROM jobs""")
def f_status(spark, sf):
    jobs = derived(spark, sf, "jobs").select("id", "status")
    parts = [("open", U.by_status(jobs, statuses=["queued", "running"])),
             ("failed", U.by_status(jobs, status="failed")), ("any", U.by_status(jobs))]
    out = None
    for name, df in parts:
        part = df.select(F.lit(name).alias("filter"), "id", "status")
        out = part if out is None else out.unionByName(part)
    return out


@query("s_hour", cte("attempts") + """SELECT id, date_trunc('hour', ts) AS hour_start,
  ip || '|' || tool || '|' || strftime(ts, '%Y%m%d%H') AS quota_id FROM attempts""")
def s_hour(spark, sf):
    return derived(spark, sf, "attempts").select(
        "id", V.hour_start(F.col("ts")).alias("hour_start"),
        V.quota_key(F.col("ip"), F.col("tool"), F.col("ts")).alias("quota_id"))


@query("s_parse_iso", cte("jobs") + """SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN NULL
  WHEN CAST(id AS BIGINT) % 7 = 0 THEN NULL ELSE created_at END AS parsed FROM jobs""")
def s_parse_iso(spark, sf):
    n = F.col("id").cast("long")
    text = (F.when(n % 5 == 0, "").when(n % 7 == 0, "not a time")
            .otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return derived(spark, sf, "jobs").select("id", V.parse_iso(text).alias("parsed"))


@query("a_status", JOBS + """SELECT 'jobs' AS measure, 'total' AS name, count(*) AS count FROM jobs
  UNION ALL SELECT 'status', status, count(*) FROM jobs GROUP BY ALL UNION ALL SELECT 'tool', tool, count(*) FROM jobs GROUP BY ALL
  UNION ALL SELECT 'files', 'total', count(*) FROM files""")
def a_status(spark, sf):
    return U.status_overview(derived(spark, sf, "jobs"), derived(spark, sf, "files"))


@query("a_quota_used", cte("attempts") + """SELECT ip || '|' || tool || '|' || strftime(h, '%Y%m%d%H') AS id, ip, tool, h AS window_start, used,
  greatest(0, 5 - used) AS remaining, used < 5 AS allowed FROM
  (SELECT ip, tool, date_trunc('hour', ts) AS h, count(*) AS used FROM attempts WHERE succeeded GROUP BY ALL)""")
def a_quota_used(spark, sf):
    return U.quota_usage(derived(spark, sf, "attempts"))


@query("w_quota_gate", cte("attempts") + """SELECT id, used_before, used_before < 5 AS allowed FROM (SELECT id,
  coalesce(sum(succeeded::INT) OVER (PARTITION BY ip, tool, date_trunc('hour', ts) ORDER BY ts, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM attempts)""")
def w_quota_gate(spark, sf):
    return U.quota_gate(derived(spark, sf, "attempts")).select("id", "used_before", "allowed")


@query("j_job_files", JOB_FILES + """SELECT e.id, count(*) AS inputs, count(*) FILTER (WHERE f.id IS NULL) AS missing,
  sum(f.size_bytes) AS total_bytes, string_agg(coalesce(f.filename, '?'), ',' ORDER BY e.pos) AS filenames,
  CASE WHEN count(*) FILTER (WHERE f.id IS NULL) > 0 THEN 'missing_input' END AS error_code
  FROM exploded e LEFT JOIN files f ON f.id = e.file_id GROUP BY e.id""")
def j_job_files(spark, sf):
    return U.job_inputs(jobs_with_inputs(spark, sf), derived(spark, sf, "files")).withColumn(
        "filenames", F.array_join("filenames", ","))


_SPECS = ", ".join(f"('{k}', '{kind}', {lo}, {hi})" for k, _, kind, lo, hi, _ in TOOLS if k != "crop")


@query("f_job_eligible", JOB_FILES.rstrip() + f""",
  spec AS (SELECT * FROM (VALUES {_SPECS}) v(tool, kind, lo, hi)),
  bad AS (SELECT e.id, arg_min(problem, pos) AS first FROM (SELECT e.id, e.pos, CASE WHEN coalesce(f.status, '') <> 'validated' THEN 'input_not_ready'
    WHEN s.kind = 'pdf' AND f.mime <> 'application/pdf' THEN 'pdf_required'
    WHEN s.kind = 'image' AND f.mime NOT IN ('image/png', 'image/jpeg', 'image/webp') THEN 'image_required' END AS problem
    FROM exploded e LEFT JOIN files f ON f.id = e.file_id LEFT JOIN spec s ON s.tool = e.tool) e WHERE problem IS NOT NULL GROUP BY 1)
  SELECT jf.id, jf.tool, CASE WHEN s.tool IS NULL THEN 'unknown_tool'
    WHEN n < lo OR n > hi THEN 'bad_input_count' ELSE bad.first END AS reason
  FROM jf JOIN (SELECT id, count(*) AS n FROM exploded GROUP BY 1) c ON c.id = jf.id
  LEFT JOIN spec s ON s.tool = jf.tool LEFT JOIN bad ON bad.id = jf.id""")
def f_job_eligible(spark, sf):
    catalog = tool_catalog(spark).filter("key <> 'crop'")
    return U.admit_jobs(jobs_with_inputs(spark, sf), catalog, derived(spark, sf, "files"))


@query("f_output_cap", JOBS + """SELECT id, CASE WHEN output_bytes > 52428800 THEN 'failed' ELSE status END AS status,
  CASE WHEN output_bytes > 52428800 THEN 'output_too_large' END AS error_code FROM jobs""")
def f_output_cap(spark, sf):
    return U.cap_output(derived(spark, sf, "jobs"), S.MAX_DOWNLOAD_BYTES).select("id", "status", "error_code")


@query("st_orphans", JOBS + """SELECT id, CASE WHEN status IN ('running', 'queued') THEN 'failed' ELSE status END AS status,
  CASE WHEN status IN ('running', 'queued') THEN 'server_restart' END AS error_code FROM jobs""")
def st_orphans(spark, sf):
    return U.recover_orphans(derived(spark, sf, "jobs")).select("id", "status", "error_code")


@query("w_latest_state", cte("job_events") + """SELECT job_id, status, ts AS updated_at, n AS events FROM
  (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM job_events) WHERE r = 1""")
def w_latest_state(spark, sf):
    return U.latest_state(derived(spark, sf, "job_events"))


@query("w_transitions", cte("job_events") + """SELECT seq, job_id, before, status, CASE WHEN before IS NULL THEN status = 'queued' ELSE
  before || '>' || status IN ('queued>running', 'queued>cancelled', 'running>succeeded', 'running>failed', 'failed>queued', 'cancelled>queued', 'failed>running') END AS legal
  FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS before FROM job_events)""")
def w_transitions(spark, sf):
    return U.status_moves(derived(spark, sf, "job_events")).select("seq", "job_id", "before", "status", "legal")


@query("j_dup_job", cte("submissions") + """SELECT s.id, (SELECT o.id FROM submissions o WHERE o.tool = s.tool AND o.file_ids = s.file_ids AND o.options = s.options
  AND o.status IN ('queued', 'running') AND (o.created_at, o.id) < (s.created_at, s.id)
  AND o.created_at >= s.created_at - INTERVAL 10 MINUTE ORDER BY o.created_at DESC, o.id DESC LIMIT 1) AS duplicate_of FROM submissions s""")
def j_dup_job(spark, sf):
    return U.pair_duplicates(derived(spark, sf, "submissions")).select("id", "duplicate_of")


# Exact reuse skips reused submissions, so SQL follows it job by job.
@query("st_dup_jobs", cte("submissions") + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY tool, file_ids, options ORDER BY created_at, id) AS r FROM submissions),
  fold AS (WITH RECURSIVE f AS (
    SELECT tool, file_ids, options, r, id, id AS job_id, CASE WHEN status IN ('queued', 'running') THEN id END AS open_id,
      CASE WHEN status IN ('queued', 'running') THEN created_at END AS open_at FROM ordered WHERE r = 1
    UNION ALL SELECT o.tool, o.file_ids, o.options, o.r, o.id,
      CASE WHEN f.open_at >= o.created_at - INTERVAL 10 MINUTE THEN f.open_id ELSE o.id END,
      CASE WHEN f.open_at >= o.created_at - INTERVAL 10 MINUTE THEN f.open_id WHEN o.status IN ('queued', 'running') THEN o.id ELSE f.open_id END,
      CASE WHEN f.open_at >= o.created_at - INTERVAL 10 MINUTE THEN f.open_at WHEN o.status IN ('queued', 'running') THEN o.created_at ELSE f.open_at END
    FROM f JOIN ordered o ON o.tool = f.tool AND o.file_ids = f.file_ids AND o.options = f.options AND o.r = f.r + 1)
    SELECT * FROM f)
  SELECT id, job_id FROM fold""")
def st_dup_jobs(spark, sf):
    return U.reuse_duplicates(derived(spark, sf, "submissions")).select("id", "job_id")


# Blocked tries are not recorded, so SQL follows the attempts of an address one by one.
@query("st_lockout", cte("logins") + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY created_at, id) AS r FROM logins),
  fold AS (WITH RECURSIVE f AS (
    SELECT ip, 0::BIGINT AS r, NULL::BIGINT AS id, []::TIMESTAMP[] AS fails, '' AS outcome FROM (SELECT DISTINCT ip FROM logins)
    UNION ALL SELECT o.ip, o.r, o.id, CASE WHEN len(live) >= 5 OR o.success THEN live ELSE list_append(live, o.created_at) END,
      CASE WHEN len(live) >= 5 THEN 'blocked' WHEN o.success THEN 'ok' ELSE 'failed' END
    FROM (SELECT o.*, list_filter(f.fails, lambda t: t > o.created_at - INTERVAL 900 SECOND) AS live FROM f JOIN ordered o ON o.ip = f.ip AND o.r = f.r + 1) o)
    SELECT * FROM f WHERE r > 0)
  SELECT id, ip, outcome FROM fold""")
def st_lockout(spark, sf):
    return U.lockouts(derived(spark, sf, "logins")).select("id", "ip", "outcome")


@query("a_failed_recent", cte("logins") + "SELECT sum(CASE WHEN success THEN 0 ELSE 1 END) AS failed, count(*) AS attempts FROM logins")
def a_failed_recent(spark, sf):
    return U.failed_logins(derived(spark, sf, "logins"))
