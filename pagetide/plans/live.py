"""Streaming queries, run over the given tables until all input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import traffic
from ..session import checkpoint_root
from ..streaming import counters, stateful, visits
from . import usage as batch_usage
from .inputs import DERIVED, cte, derived, source
from .registry import ORACLES, query
from .traffic import ALL, PATH


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(spark, sf, name):
    """A derived table as a stream over the folder of its base table."""
    base, columns = DERIVED[name]
    raw = visits.read_requests(spark, sf, source(spark, sf, base).schema, f"{base}.parquet")
    out = raw.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    local = {f.name: F.col(f.name).cast("timestamp_ntz") for f in out.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return out.withColumns(local) if local else out


def run_to_table(spark, df, output_mode="append"):
    """Run a stream to the end of its input and return what it wrote."""
    folder, key = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, stateful.ROCKSDB)
    try:
        stream = (df.writeStream.format("parquet").outputMode(output_mode).option("path", f"{folder}/out")
                  .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        stream.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("st_visits", ALL + """SELECT 'visit' AS kind, id, concat_ws('|', ip_trunc, coalesce(country, '?'), coalesce(city, '?'), device, browser, source, path) AS detail, created_at FROM visits
  UNION ALL SELECT 'bot', id, concat_ws('|', name, coalesce(country, '?'), path), created_at FROM bots""")
def st_visits(spark, sf):
    folder = _folder(spark)
    query_ = visits.start_visit_stream(stream_of(spark, sf, "requests"), derived(spark, sf, "geo_blocks"),
                                       f"{folder}/out", f"{folder}/checkpoint", available_now=True, path_chars=PATH)
    query_.awaitTermination()
    country, city = (F.coalesce(c, F.lit("?")) for c in ("country", "city"))
    humans = visits.read_table(spark, f"{folder}/out", "visits").select(
        F.lit("visit").alias("kind"), "id",
        F.concat_ws("|", "ip_trunc", country, city, "device", "browser", "source", "path").alias("detail"), "created_at")
    bots = visits.read_table(spark, f"{folder}/out", "bot_visits").select(
        F.lit("bot").alias("kind"), "id", F.concat_ws("|", "name", country, "path").alias("detail"), "created_at")
    return humans.unionByName(bots)


@query("src_requests", cte("requests") + "SELECT request_id, ts, path, user_agent FROM requests")
def src_requests(spark, sf):
    return run_to_table(spark, stream_of(spark, sf, "requests").select("request_id", "ts", "path", "user_agent"))


@query("st_tumbling", cte("attempts") + """SELECT ip, tool, date_trunc('hour', ts) AS window_start, count(*) AS used FROM attempts WHERE succeeded GROUP BY ALL""")
def st_tumbling(spark, sf):
    folder = _folder(spark)
    keys = ["ip", "tool", "window_start"]
    counters.start_upserts(counters.hourly_usage(stream_of(spark, sf, "attempts")), f"{folder}/out",
                           f"{folder}/checkpoint", keys, "window_start", available_now=True).awaitTermination()
    return counters.current_counts(spark, f"{folder}/out", keys, "window_start")


def _daily(spark, sf):
    """Folder of the by-day view of the visits, with each day's three largest browsers."""
    folder = _folder(spark)
    located = traffic.without_geo(traffic.tracked_requests(stream_of(spark, sf, "requests")))
    counters.start_upserts(counters.daily_counts(traffic.to_visits(located, PATH), "browser"), f"{folder}/out",
                           f"{folder}/checkpoint", ["date", "browser"], "date", available_now=True,
                           top=("count", 3)).awaitTermination()
    return f"{folder}/out"


@query("st_daily", ALL + "SELECT strftime(created_at, '%Y-%m-%d') AS date, browser, count(*) AS count FROM visits GROUP BY ALL")
def st_daily(spark, sf):
    return counters.current_counts(spark, _daily(spark, sf), ["date", "browser"], "date")


@query("st_daily_top", ALL + """SELECT date, rank, browser, count FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY count DESC, browser)::INT AS rank
  FROM (SELECT strftime(created_at, '%Y-%m-%d') AS date, browser, count(*) AS count FROM visits GROUP BY ALL)) WHERE rank <= 3""")
def st_daily_top(spark, sf):
    return counters.current_top(spark, _daily(spark, sf)).select("date", "rank", "browser", "count")


@query("st_ttl", ALL + "SELECT 'visits' AS tbl, count(*) AS kept FROM visits WHERE created_at >= (SELECT max(ts) FROM requests) - INTERVAL 7 DAY")
def st_ttl(spark, sf):
    """What a visit stream with seven days of retention leaves in its table."""
    folder = _folder(spark)
    visits.start_visit_stream(stream_of(spark, sf, "requests"), derived(spark, sf, "geo_blocks"), f"{folder}/out",
                              f"{folder}/checkpoint", available_now=True, retention_days=7, path_chars=PATH).awaitTermination()
    kept = visits.read_table(spark, f"{folder}/out", "visits", 7)
    return kept.agg(F.count("*").alias("kept")).select(F.lit("visits").alias("tbl"), "kept")


@query("st_lockout_stream", ORACLES["st_lockout"])
def st_lockout_stream(spark, sf):
    return run_to_table(spark, stateful.lockout_stream(stream_of(spark, sf, "logins")))


@query("st_dup_jobs_stream", ORACLES["st_dup_jobs"])
def st_dup_jobs_stream(spark, sf):
    return run_to_table(spark, stateful.duplicate_stream(stream_of(spark, sf, "submissions")))


_MOVES = ", ".join(f"'{a}>{b}'" for a, b in batch_usage.U.LEGAL_MOVES)


@query("st_job_state", cte("job_events") + f""", ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS r FROM job_events),
  fold AS (WITH RECURSIVE f AS (
    SELECT job_id, 0::BIGINT AS r, NULL::BIGINT AS seq, NULL::VARCHAR AS current, false AS accepted FROM (SELECT DISTINCT job_id FROM job_events)
    UNION ALL SELECT o.job_id, o.r, o.seq, CASE WHEN o.ok THEN o.status ELSE o.current END, o.ok FROM
      (SELECT o.*, f.current, CASE WHEN f.current IS NULL THEN o.status = 'queued' ELSE f.current || '>' || o.status IN ({_MOVES}) END AS ok FROM f JOIN ordered o ON o.job_id = f.job_id AND o.r = f.r + 1) o)
    SELECT * FROM f WHERE r > 0)
  SELECT seq, job_id, current AS status, accepted FROM fold""")
def st_job_state(spark, sf):
    return run_to_table(spark, stateful.job_state_stream(stream_of(spark, sf, "job_events")))
