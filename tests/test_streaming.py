"""Streams against their batch twins, with several micro-batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from pagetide.operators import traffic, usage
from pagetide.plans.inputs import DERIVED, derived, source
from pagetide.streaming import counters, stateful, visits


def folders():
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return root, f"{root}/in", f"{root}/out", f"{root}/checkpoint"


def in_time_slices(spark, sf_dir, name, ts, slices=3):
    """A derived table written as files in time order, read one file per micro-batch."""
    root, folder, out, checkpoint = folders()
    table = derived(spark, sf_dir, name)
    cuts = table.select(F.percentile(F.unix_micros(F.col(ts).cast("timestamp")), [i / slices for i in range(1, slices)]).alias("c")).first().c
    slice_no = sum([(F.unix_micros(F.col(ts).cast("timestamp")) >= c).cast("int") for c in cuts], F.lit(0))
    for i in range(slices):
        table.filter(slice_no == i).coalesce(1).write.mode("append").parquet(folder)
    stream = visits.read_requests(spark, folder, table.schema, files_per_trigger=1)
    return table, stream, out, checkpoint


def run(df, out, checkpoint):
    (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(out)


def rows(df):
    return sorted(map(str, df.collect()))


def test_visits_and_replay(spark, sf_dir):
    table, stream, out, checkpoint = in_time_slices(spark, sf_dir, "requests", "ts")
    blocks = derived(spark, sf_dir, "geo_blocks")
    visits.start_visit_stream(stream, blocks, out, checkpoint, available_now=True).awaitTermination()
    located = traffic.geo_lookup(traffic.tracked_requests(table), blocks)
    cols = ["id", "ip_trunc", "country", "browser", "path", "created_at"]
    want = rows(traffic.to_visits(located).select(cols))
    assert rows(visits.read_table(spark, out, "visits").select(cols)) == want
    # everything again from the start, over the same output: no duplicates
    visits.start_visit_stream(stream, blocks, out, checkpoint + "-again", available_now=True).awaitTermination()
    assert rows(visits.read_table(spark, out, "visits").select(cols)) == want


def test_lockout(spark, sf_dir):
    table, stream, out, checkpoint = in_time_slices(spark, sf_dir, "logins", "created_at")
    got = run(stateful.lockout_stream(stream), out, checkpoint)
    assert rows(got) == rows(usage.lockouts(table).select("id", "ip", "outcome"))


def test_duplicate_reuse(spark, sf_dir):
    table, stream, out, checkpoint = in_time_slices(spark, sf_dir, "submissions", "created_at")
    got = run(stateful.duplicate_stream(stream), out, checkpoint)
    assert rows(got) == rows(usage.reuse_duplicates(table).select("id", "job_id"))


def test_hourly_usage(spark, sf_dir):
    table, stream, out, checkpoint = in_time_slices(spark, sf_dir, "attempts", "ts")
    keys = ["ip", "tool", "window_start"]
    counters.start_upserts(counters.hourly_usage(stream), out, checkpoint, keys, "window_start", available_now=True).awaitTermination()
    got = counters.current_counts(spark, out, keys, "window_start")
    assert rows(got.select(*keys, "used")) == rows(usage.quota_usage(table).select(*keys, "used"))


def test_drop_repeats_keeps_one_per_fingerprint(spark, sf_dir):
    _, stream, out, checkpoint = in_time_slices(spark, sf_dir, "submissions", "created_at")
    got = run(stateful.drop_repeats(stream), out, checkpoint)
    assert 0 < got.count() < source(spark, sf_dir, DERIVED["submissions"][0]).count()


def test_a_table_of_part_files_streams_whole(spark, sf_dir, tmp_path):
    from pagetide.plans.live import run_to_table
    from pagetide.streaming import visits

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for folder in (str(tmp_path), sf_dir):
        stream = visits.read_requests(spark, folder, table.schema, "events.parquet")
        assert run_to_table(spark, stream).count() == table.count()


def at(minutes):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def in_files(spark, batches, schema):
    """A stream that reads one of ``batches`` a micro-batch, in their order."""
    import os
    import time

    root, folder, out, checkpoint = folders()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(f"{folder}/{name}", f"{folder}/b{i}.parquet")
                os.utime(f"{folder}/b{i}.parquet", (time.time() - 1000 + i,) * 2)
    return visits.read_requests(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1), out, checkpoint


def state_of(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


LOGINS = "id long, ip string, success boolean, created_at timestamp_ntz"


def test_lockout_state_ends_with_its_window_and_late_rows_are_dropped(spark):
    batches = [[(i, "a", False, at(i)) for i in range(6)] + [(9, "b", False, at(0))],
               [(10, "c", True, at(600))],   # the watermark moves past both windows
               [(13, "c", True, at(600))],   # and holds for what comes after the next batch
               [(11, "a", False, at(601)), (12, "b", False, at(1))]]  # one timely row, one far too late
    stream, out, checkpoint = in_files(spark, batches, LOGINS)
    got = {r.id: r.outcome for r in run(stateful.lockout_stream(stream, "10 minutes"), out, checkpoint).collect()}
    assert got == {0: "failed", 1: "failed", 2: "failed", 3: "failed", 4: "failed", 5: "blocked", 9: "failed",
                   10: "ok", 13: "ok", 11: "failed"}
    left = state_of(spark, checkpoint, "failures").collect()
    assert len(left) == 1 and left[0].key[0] == "a"  # only the newest failure is still held


def test_job_state_is_forgotten_after_the_retention_time(spark):
    day = 24 * 60
    batches = [[(1, 7, "queued", at(0)), (2, 8, "queued", at(0))], [(3, 8, "running", at(8 * day))],
               [(4, 9, "queued", at(10 * day))], [(7, 9, "running", at(10 * day))], [(5, 7, "running", at(10 * day + 1)), (6, 8, "succeeded", at(10 * day + 1))]]
    stream, out, checkpoint = in_files(spark, batches, "seq long, job_id long, status string, ts timestamp_ntz")
    got = {r.seq: (r.status, r.accepted) for r in run(stateful.job_state_stream(stream), out, checkpoint).collect()}
    assert got[5] == (None, False)  # job 7 had no event for seven days and is no longer known
    assert got[3] == ("running", True) and got[6] == ("succeeded", True)
    assert {r.key[0] for r in state_of(spark, checkpoint, "status").collect()} == {8, 9}


def test_open_jobs_without_events_fail(spark):
    import time

    batches = [[(1, 7, "queued", at(0)), (2, 8, "queued", at(0)), (3, 8, "running", at(1)), (4, 8, "succeeded", at(2))],
               [(5, 7, "running", at(3)), (6, 9, "cancelled", at(3))]]
    stream, out, checkpoint = in_files(spark, batches, "seq long, job_id long, status string, ts timestamp_ntz")
    query = (stateful.orphan_stream(stream, 6).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start())
    try:
        end, failed = time.time() + 90, []
        while not failed and time.time() < end and query.isActive:
            time.sleep(1)
            if query.lastProgress is not None:
                failed = [tuple(r) for r in spark.read.schema("job_id long, status string, error_code string").parquet(out)
                          .where("error_code is not null").collect()]
    finally:
        query.stop()
    assert failed == [(7, "failed", "server_restart")]


def test_batch_table_stays_small_and_forgets_days(spark):
    import datetime as dt

    from pagetide.streaming.tables import BatchTable

    root = folders()[0]
    table = BatchTable(spark, f"{root}/t", "at", ["k"], retention_days=2, fanout=3)
    want = {}
    for i in range(14):
        when = dt.datetime(2024, 1, 1 + i // 3, i % 24)
        rows = [(i % 5, i, when), (100 + i, i, when)]
        batch = spark.createDataFrame(rows, "k long, v long, at timestamp_ntz")
        assert table.commit(batch, i, when, "w")
        assert not table.commit(batch, i, when, "w")  # run again: nothing changes
        want.update({r[0]: r for r in rows})
        assert len(table.manifest()["entries"]) <= 2 * 3
    newest = dt.datetime(2024, 1, 5, 13)
    kept = [r for r in want.values() if r[2] >= newest - dt.timedelta(days=2)]
    assert rows_of(table.read()) == sorted(kept)
    assert rows_of(table.read(["2024-01-05"])) == sorted(r for r in kept if r[2].day == 5)
    assert all(d >= "2024-01-03" for e in table.manifest()["entries"] for d in e["days"])
    # a stream with another checkpoint counts its own batches
    assert table.commit(spark.createDataFrame([(500, 1, newest)], "k long, v long, at timestamp_ntz"), 0, newest, "other")
    assert 500 in {r.k for r in table.read().collect()}
    live = {e["folder"] for e in table.manifest()["entries"]}
    import os

    on_disk = {n for n in os.listdir(f"{root}/t") if n != "manifest"}
    assert live <= on_disk and len(on_disk) <= len(live) + 2 * 3


def rows_of(df):
    return sorted(tuple(r) for r in df.select("k", "v", "at").collect())


def test_daily_top_follows_the_counts(spark, sf_dir):
    table, stream, out, checkpoint = in_time_slices(spark, sf_dir, "requests", "ts", slices=4)
    located = traffic.without_geo(traffic.tracked_requests(stream))
    keys = ["date", "browser"]
    counters.start_upserts(counters.daily_counts(traffic.to_visits(located), "browser"), out, checkpoint, keys, "date",
                           available_now=True, top=("count", 2)).awaitTermination()
    exact = traffic.to_visits(traffic.without_geo(traffic.tracked_requests(table))).groupBy(
        F.date_format("created_at", "yyyy-MM-dd").alias("date"), "browser").count()
    assert rows(counters.current_counts(spark, out, keys, "date").select(*keys, "count")) == rows(exact.select(*keys, "count"))
    best = counters.largest(exact.withColumn("_at", F.col("date").cast("timestamp_ntz")), keys, "date", "count", 2)
    columns = ["date", "rank", "browser", "count"]
    assert rows(counters.current_top(spark, out).select(columns)) == rows(best.select(columns))
