"""Jobs, quotas, duplicate submissions, lockouts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import values as V
from ..session import discard, store
from .skew import minute, previous_value, running_total, salted_lookup
from .traffic import as_of_column

# Legal status moves.
LEGAL_MOVES = (
    ("queued", "running"), ("queued", "cancelled"),
    ("running", "succeeded"), ("running", "failed"),
    ("failed", "queued"), ("cancelled", "queued"), ("failed", "running"),
)


def by_status(jobs: DataFrame, statuses: list[str] | None = None, status: str | None = None) -> DataFrame:
    """Optional equality or membership filter on status."""
    if statuses:
        return jobs.filter(F.col("status").isin(*statuses))
    return jobs.filter(F.col("status") == status) if status else jobs


# ------------------------------------------------------------------- quotas

def quota_usage(attempts: DataFrame, limit: int = S.QUOTA_PER_HOUR) -> DataFrame:
    """Successes per (ip, tool, calendar hour), with what is left.

    A calendar-hour bucket, not a rolling hour; the count is an aggregate with
    map-side partial sums, so one busy address is no bottleneck.
    """
    hour = V.hour_start(F.col("ts"))
    used = F.count(F.lit(1))
    return (
        attempts.filter("succeeded").groupBy("ip", "tool", hour.alias("window_start"))
        .agg(used.alias("used"))
        .select(
            F.concat_ws("|", "ip", "tool", F.date_format("window_start", "yyyyMMddHH")).alias("id"),
            "ip", "tool", "window_start", "used",
            F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"),
            (F.col("used") < limit).alias("allowed"),
        )
    )


def quota_gate(attempts: DataFrame, limit: int = S.QUOTA_PER_HOUR) -> DataFrame:
    """Whether each attempt may run: fewer than ``limit`` earlier successes in its hour.

    A refused attempt cannot succeed, but once the limit is reached every later
    attempt of the hour is refused anyway, so the plain running count is exact.
    The hour is cut at seconds to spread a busy address.
    """
    hour = V.hour_start(F.col("ts"))
    second = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    counted = running_total(
        attempts.withColumn("window_start", hour), ["ip", "tool", "window_start"], second,
        [F.col("ts"), F.col("id")], F.col("succeeded").cast("int"), "used_before", include_self=False,
    )
    return counted.withColumn("allowed", F.col("used_before") < limit)


# --------------------------------------------------------------- job tables

def status_overview(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Files, jobs, jobs by status and by tool as (measure, name, count) rows; one job scan."""
    counts = jobs.groupingSets([[], ["status"], ["tool"]], "status", "tool").agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_g"))
    measure = F.when(F.col("_g") == 3, "jobs").when(F.col("_g") == 1, "status").otherwise("tool")
    total_files = files.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("files").alias("measure"), F.lit("total").alias("name"), "count")
    return counts.select(
        measure.alias("measure"),
        F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, F.col("status")).otherwise(F.col("tool")).alias("name"),
        "count",
    ).unionByName(total_files)


def job_inputs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with their inputs looked up, in order; any unknown id gives ``missing_input``.

    A file shared by many jobs is a hot key, so the lookup is salted by job. The lists
    collected again are no longer than the ones the job rows hold.
    """
    wanted = jobs.select("id", F.posexplode(F.from_json("file_ids", "array<string>")).alias("pos", "file_id"))
    known = files.select(F.col("id").alias("file_id"), "filename", "size_bytes", F.lit(True).alias("_found"))
    found = salted_lookup(wanted, known, ["file_id"], ["id", "pos"])
    item = F.struct("pos", F.coalesce("filename", F.lit("?")).alias("filename"))
    missing = F.count_if(F.col("_found").isNull())
    return found.groupBy("id").agg(
        F.count(F.lit(1)).alias("inputs"),
        missing.alias("missing"),
        F.sum("size_bytes").alias("total_bytes"),
        F.transform(F.array_sort(F.collect_list(item)), lambda s: s["filename"]).alias("filenames"),
    ).withColumn("error_code", F.when(F.col("missing") > 0, S.MISSING_INPUT))


def admit_jobs(jobs: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """First failing admission rule per job, or null.

    The catalog has a fixed number of rows (one per tool), so it is broadcast.
    """
    spec = catalog.select(F.col("key").alias("tool"), "min_files", "max_files",
                          F.element_at("input_kinds", 1).alias("input_kind"))
    known = jobs.select("id", "tool", F.from_json("file_ids", "array<string>").alias("ids"))
    known = known.join(F.broadcast(spec), "tool", "left")
    wanted = known.select("id", "input_kind", F.posexplode("ids").alias("pos", "file_id"))
    ready = files.select(F.col("id").alias("file_id"), "mime", F.col("status").alias("_status"))
    looked = salted_lookup(wanted, ready, ["file_id"], ["id", "pos"])
    mime_ok = (
        F.when(F.col("input_kind") == "pdf", F.col("mime") == V.PDF_MIME)
        .when(F.col("input_kind") == "image", F.col("mime").isin(*V.IMAGE_MIMES))
        .otherwise(True)
    )
    problem = (
        F.when(F.coalesce(F.col("_status") != "validated", F.lit(True)), "input_not_ready")
        .when(~F.coalesce(mime_ok, F.lit(False)), F.concat("input_kind", F.lit("_required")))
    )
    first = looked.withColumn("_p", problem).groupBy("id").agg(
        F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("pos"))).alias("_first"))
    return known.join(first, "id", "left").select(
        "id", "tool",
        F.when(F.col("min_files").isNull(), "unknown_tool")
        .when(~F.size("ids").between(F.col("min_files"), F.col("max_files")), "bad_input_count")
        .otherwise(F.col("_first")).alias("reason"),
    )


def cap_output(jobs: DataFrame, limit: int) -> DataFrame:
    """Jobs whose output is over ``limit`` bytes fail."""
    over = F.col("output_bytes") > limit
    return jobs.withColumns({
        "error_code": F.when(over, F.lit(S.OUTPUT_TOO_LARGE)),
        "status": F.when(over, "failed").otherwise(F.col("status")),
    })


def recover_orphans(jobs: DataFrame) -> DataFrame:
    """After a restart, open jobs are failed."""
    open_job = F.col("status").isin(*S.OPEN_JOB_STATUSES)
    return jobs.withColumns({
        "error_code": F.when(open_job, F.lit(S.SERVER_RESTART)),
        "status": F.when(open_job, "failed").otherwise(F.col("status")),
    })


def latest_state(events: DataFrame) -> DataFrame:
    """Current status per job: an aggregate with map-side combine, no sort."""
    newest = F.struct("ts", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", newest).alias("status"), F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("events"),
    )


def status_moves(events: DataFrame) -> DataFrame:
    """Each event with the status before it and whether the move is legal.

    A first event must be ``queued``. Histories are cut at minutes.
    """
    moved = previous_value(events, ["job_id"], minute(F.col("ts")), [F.col("ts"), F.col("seq")],
                           F.col("status"), "before")
    legal = F.lit(False)
    for a, b in LEGAL_MOVES:
        legal = legal | ((F.col("before") == a) & (F.col("status") == b))
    return moved.withColumn(
        "legal", F.when(F.col("before").isNull(), F.col("status") == "queued").otherwise(legal))


# ------------------------------------------------------ duplicate submissions

def fingerprint() -> Column:
    """Exact text identity of a submission; key order in the JSON text matters."""
    return F.sha2(F.concat_ws("\x1f", "tool", "file_ids", "options"), 256)


def pair_duplicates(jobs: DataFrame, window_seconds: int = S.DUPLICATE_WINDOW_SECONDS) -> DataFrame:
    """Newest earlier open identical job within the window, per submission.

    An as-of lookup by one window pass (no self join), cut at minutes.
    """
    open_job = F.when(F.col("status").isin(*S.OPEN_JOB_STATUSES), F.struct("id", "created_at"))
    paired = previous_value(jobs, ["tool", "file_ids", "options"], minute(F.col("created_at")),
                            [F.col("created_at"), F.col("id")], open_job, "_match")
    fresh = F.col("_match.created_at") >= F.col("created_at") - F.make_dt_interval(secs=F.lit(window_seconds))
    return paired.withColumn("duplicate_of", F.when(fresh, F.col("_match.id"))).drop("_match")


def _earlier(rows: DataFrame, number: str, back: int, name: str) -> DataFrame:
    """``rows`` with the time of the row ``back`` places before it, by the dense ``number`` of an address."""
    before = rows.select("_key", (F.col(number) + back).alias(number), F.col("created_at").alias(name))
    return rows.join(before, ["_key", number], "left")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    return running_total(rows, ["_key"], minute(F.col("created_at")), [F.col("created_at"), F.col("id")], F.lit(1), name)


def _recorded_of_zones(zones: DataFrame, max_failures: int, window_seconds: int) -> DataFrame:
    """(_key, _n) of the failures that are recorded, zone by zone. A zone streams in order and only
    the last recorded times are held; what is blocked is skipped by search, not row by row."""
    width = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live = None, []
        for batch in batches:
            times = batch["created_at"].to_numpy("datetime64[us]").astype("int64")
            turns = (batch["_key"] != batch["_key"].shift()) | (batch["_zone"] != batch["_zone"].shift())
            starts, kept = np.flatnonzero(turns.to_numpy()).tolist(), []
            for at, end in zip(starts, [*starts[1:], len(batch)]):
                zone = (batch["_key"].iat[at], batch["_zone"].iat[at])
                if zone != current:
                    current, live = zone, []
                while at < end:
                    if len(live) == max_failures and live[0] > times[at] - width:
                        at += int(np.searchsorted(times[at:end], live[0] + width))
                        continue
                    kept.append(at)
                    live = [*live, int(times[at])][-max_failures:]
                    at += 1
            yield batch.iloc[kept][["_key", "_n"]]

    # bound by work per row: keep the width that small inputs would otherwise lose
    shards = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = zones.repartition(shards, "_key", "_zone").sortWithinPartitions("_key", "_zone", "created_at", "id")
    return spread.select("_key", "_zone", "_n", "created_at").mapInPandas(run, "_key string, _n long")


def recorded_failures(logins: DataFrame, max_failures: int, window_seconds: int) -> DataFrame:
    """(_key, id, created_at) of the failures that are recorded; blocked ones are not.

    A failure with fewer than ``max_failures`` failures in the window before it is surely recorded,
    whatever came earlier. Only from a crowded failure until a window has passed without one is the
    rule recursive; such a zone starts from failures that are all surely recorded, so zones are
    independent of each other and of the rest. All other work is spread by minutes and by numbers.
    """
    order, window = [F.col("created_at"), F.col("id")], F.make_dt_interval(secs=F.lit(window_seconds))
    fails = store(_earlier(store(_numbered(logins, "_n"), "numbered"), "_n", max_failures, "_limit"), "limits")
    crowded = F.coalesce(F.col("_limit") > F.col("created_at") - window, F.lit(False))
    fails = previous_value(fails.withColumn("_crowded", crowded), ["_key"], minute(F.col("created_at")), order,
                           F.when(F.col("_crowded"), F.col("created_at")), "_doubt")
    near = F.coalesce(F.col("_doubt") > F.col("created_at") - window, F.lit(False))
    fails = fails.withColumns({"_inside": near | F.col("_crowded"),
                               "_open": F.when(F.col("_crowded") & ~near, F.col("_n"))})
    fails = previous_value(fails, ["_key"], minute(F.col("created_at")), order, F.col("_open"), "_opened")
    zone = F.when(F.col("_inside"), F.coalesce("_open", "_opened"))
    fails = store(fails.withColumn("_zone", zone).select("_key", "id", "created_at", "_n", "_zone"), "failures")
    heads = fails.filter("_n = _zone").select(
        "_key", "_zone", F.explode(F.sequence(F.col("_n") - max_failures, F.col("_n") - 1)).alias("_n"))
    before = fails.drop("_zone").join(heads, ["_key", "_n"])
    inside = fails.filter("_zone IS NOT NULL")
    found = _recorded_of_zones(inside.unionByName(before), max_failures, window_seconds)
    return fails.filter("_zone IS NULL").unionByName(inside.join(found, ["_key", "_n"], "left_semi"), allowMissingColumns=True).select(
        "_key", "id", "created_at")


def lockouts(logins: DataFrame, max_failures: int = S.LOGIN_MAX_FAILURES,
             window_seconds: int = S.LOGIN_WINDOW_SECONDS) -> DataFrame:
    """Outcome per login attempt: ok, failed or blocked. ``max_failures`` is at least 1.

    Blocked attempts are not recorded. Each recorded failure knows the time of the one that is
    ``max_failures`` - 1 recorded places earlier; an attempt looks up the newest recorded failure
    before it and is blocked while that time is inside the window.
    """
    keyed = logins.withColumn("_key", F.to_json(F.struct("ip")))
    failed = ~F.coalesce("success", F.lit(False))
    recorded = recorded_failures(keyed.filter(failed).select("_key", "id", "created_at"), max_failures, window_seconds)
    marks = _earlier(store(_numbered(store(recorded, "recorded"), "_m"), "marks"), "_m", max_failures - 1, "_first").select(
        "_key", "id", "created_at", F.struct("_first").alias("_mark"))
    both = keyed.unionByName(marks, allowMissingColumns=True)
    seen = previous_value(both, ["_key"], minute(F.col("created_at")),
                          [F.col("created_at"), F.col("id"), F.col("_mark").isNotNull()], F.col("_mark"), "_last")
    blocked = F.col("_last._first") > F.col("created_at") - F.make_dt_interval(secs=F.lit(window_seconds))
    return seen.filter("_mark IS NULL").select(
        *logins.columns, F.when(blocked, "blocked").when(failed, "failed").otherwise("ok").alias("outcome"))


def _first_after(opens: DataFrame, window_seconds: int) -> DataFrame:
    """``opens`` (key, id, at) with ``next``: identifier of the first one of its key later than its
    window. Each row asks at the end of its window; going back in time, the answer is the last
    row passed before the question, so one pass cut at minutes finds all."""
    rows = opens.select("_key", "_node", F.col("_at").alias("_time"), F.lit(1).alias("_kind"))
    asked = opens.select("_key", "_node", (F.col("_at") + F.make_dt_interval(secs=F.lit(window_seconds))).alias("_time"),
                         F.lit(0).alias("_kind"))
    back = rows.unionByName(asked).withColumn("_back", -F.unix_micros(F.col("_time").cast("timestamp")))
    answered = previous_value(back, ["_key"], F.floor(F.col("_back") / 60_000_000),
                              [F.col("_back"), F.col("_kind"), -F.col("_node")],
                              F.when(F.col("_kind") == 1, F.col("_node")), "_next")
    return answered.filter("_kind = 0").select("_key", "_node", "_next")


def first_jobs(jobs: DataFrame, window_seconds: int = S.DUPLICATE_WINDOW_SECONDS) -> DataFrame:
    """(_node): identifiers of the open submissions that made a job of their own.

    An open submission with no open one in the window before it surely did. From each of these the
    next is the first open one after the window, and so on; that chain is walked by doubling: a
    round adds what lies as many steps on as there are found already, and joins the pointers with
    themselves. So log n rounds of joins, each written, find a chain of any length, and the rows of
    one key are spread over all tasks.
    """
    opens = jobs.filter(F.col("status").isin(*S.OPEN_JOB_STATUSES)).select(
        "_key", F.col("id").alias("_node"), F.col("created_at").alias("_at"))
    before = previous_value(opens, ["_key"], minute(F.col("_at")), [F.col("_at"), F.col("_node")], F.col("_at"), "_before")
    window = F.make_dt_interval(secs=F.lit(window_seconds))
    head = F.col("_before").isNull() | (F.col("_before") < F.col("_at") - window)
    known = store(before.select("_key", "_node", "_at", head.alias("_head")), "opens")
    found = known.filter("_head").select("_node")
    busy = known.filter(~F.col("_head")).select(F.col("_node").alias("_next"))  # pointers stop at heads
    step = store(_first_after(known, window_seconds).join(busy, "_next").select("_node", "_next"), "steps")
    while not step.isEmpty():
        found = store(found.unionByName(found.join(step, "_node").select(F.col("_next").alias("_node"))).distinct(), "found")
        onward = step.select(F.col("_node").alias("_next"), F.col("_next").alias("_far"))
        longer = store(step.join(onward, "_next").select("_node", F.col("_far").alias("_next")), "steps")
        discard(step)
        step = longer
    return found


def reuse_duplicates(jobs: DataFrame, window_seconds: int = S.DUPLICATE_WINDOW_SECONDS) -> DataFrame:
    """Exact duplicate reuse: a reused submission creates no job, so it cannot be matched itself.

    Only open submissions that made a job of their own can be reused; they are found by
    ``first_jobs``, and every row then looks up the newest of its key before it. ``id`` is unique.
    """
    keyed = jobs.withColumn("_key", fingerprint())
    own = first_jobs(keyed, window_seconds).select(F.col("_node").alias("id"), F.lit(True).alias("_own"))
    maker = F.when(F.col("_own"), F.struct("id", "created_at"))
    paired = previous_value(keyed.join(own, "id", "left"), ["_key"], minute(F.col("created_at")),
                            [F.col("created_at"), F.col("id")], maker, "_match")
    fresh = F.col("_match.created_at") >= F.col("created_at") - F.make_dt_interval(secs=F.lit(window_seconds))
    return paired.withColumn("job_id", F.when(fresh, F.col("_match.id")).otherwise(F.col("id"))).select(*jobs.columns, "job_id")


def failed_logins(logins: DataFrame) -> DataFrame:
    return logins.agg(F.count_if(~F.col("success")).alias("failed"), F.count(F.lit(1)).alias("attempts"))


def stale_uploads(parts: DataFrame, as_of: datetime | str, ttl_seconds: int = S.PART_TTL_SECONDS) -> DataFrame:
    """Upload sessions not touched since the cut-off."""
    cutoff = as_of_column(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return parts.groupBy("upload_id").agg(F.max("ts").alias("touched_at")).filter(F.col("touched_at") < cutoff)
