"""Rules that need keyed state: lockout, duplicate reuse, job life cycle.

All keep a few values per key and put the rows of a micro-batch in time order before they apply
the rule. Size the micro-batches (files or offsets per trigger) to bound what one key can bring at
once.

State expires: each key has one event-time timer at the moment its state can no longer matter, and
when the watermark passes it the state is cleared. ``delay`` says how far rows may come behind the
newest one seen; rows later than that are dropped before they reach a rule. Failing jobs that
never end works on processing time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..functions import values as V
from ..operators.usage import LEGAL_MOVES, fingerprint

# Spark starts the processors' set-up process without the session's added files, so they travel
# as values, with the constants they use.
for _module in (sys.modules[__name__], S):
    cloudpickle.register_pickle_by_value(_module)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(columns), kind="stable", ignore_index=True)


class _Expiring(StatefulProcessor):
    """One timer a key, moved along with its state. Subclasses say when the state ends."""

    def _arm(self, end: pd.Timestamp | None) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if end is not None:
            # the watermark counts in whole milliseconds
            self.handle.registerTimer(int(end.value // 1_000_000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        yield from ()

    def close(self) -> None:
        pass


class Lockout(_Expiring):
    """Times of recorded failures, at most ``LOGIN_MAX_FAILURES`` per address, for the length of the
    window after the newest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getListState("failures", "t timestamp_ntz")

    def forget(self) -> None:
        self.failures.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        width = pd.Timedelta(seconds=S.LOGIN_WINDOW_SECONDS)
        live = [pd.Timestamp(t) for (t,) in self.failures.get()]
        batch, outcome = _in_order(rows, "created_at", "id"), []
        for at, success in zip(batch["created_at"], batch["success"]):
            live = [t for t in live if t > at - width]
            if len(live) >= S.LOGIN_MAX_FAILURES:
                outcome.append("blocked")
            elif success:
                outcome.append("ok")
            else:
                live.append(at)
                outcome.append("failed")
        self.failures.clear()
        if live:
            self.failures.put([(t.to_pydatetime(),) for t in live])
        self._arm(live[-1] + width if live else None)
        yield pd.DataFrame({"id": batch["id"], "ip": key[0], "outcome": outcome})


class DuplicateReuse(_Expiring):
    """The newest open job of a submission fingerprint, for the length of the window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_job = handle.getValueState("open_job", "id long, t timestamp_ntz")

    def forget(self) -> None:
        self.open_job.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        width = pd.Timedelta(seconds=S.DUPLICATE_WINDOW_SECONDS)
        held = self.open_job.get() if self.open_job.exists() else None
        newest = (held[0], pd.Timestamp(held[1])) if held else None
        batch, reused = _in_order(rows, "created_at", "id"), []
        for job, at, status in zip(batch["id"], batch["created_at"], batch["status"]):
            if newest and newest[1] >= at - width:
                reused.append(newest[0])
                continue
            reused.append(job)
            if status in S.OPEN_JOB_STATUSES:
                newest = (job, at)
        if newest:
            self.open_job.update((int(newest[0]), newest[1].to_pydatetime()))
        self._arm(newest[1] + width if newest else None)
        yield pd.DataFrame({"id": batch["id"], "job_id": reused})


class JobLifeCycle(_Expiring):
    """Current status of a job; events that are no legal move are refused. A job without events for
    the retention time is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, t timestamp_ntz")

    def forget(self) -> None:
        self.status.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.status.get() if self.status.exists() else None
        current, newest = (held[0], pd.Timestamp(held[1])) if held else (None, None)
        batch, after, accepted = _in_order(rows, "ts", "seq"), [], []
        for wanted in batch["status"]:
            legal = wanted == "queued" if current is None else (current, wanted) in LEGAL_MOVES
            current = wanted if legal else current
            accepted.append(legal)
            after.append(current)
        if current is not None:
            last = batch["ts"].iloc[-1]
            newest = last if newest is None or last > newest else newest
            self.status.update((current, newest.to_pydatetime()))
            self._arm(newest + pd.Timedelta(days=S.RETENTION_DAYS))
        yield pd.DataFrame({"seq": batch["seq"], "job_id": key[0], "status": after, "accepted": accepted})


class OrphanedJobs(StatefulProcessor):
    """Open jobs and a processing-time timer each: one without an event for the time limit has lost
    its worker and fails."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current = _in_order(rows, "ts", "seq")["status"].iloc[-1]
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if current in S.OPEN_JOB_STATUSES:
            self.status.update((current,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        else:
            self.status.clear()
        yield pd.DataFrame({"job_id": [key[0]], "status": [current], "error_code": [None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.status.exists():
            self.status.clear()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "error_code": [S.SERVER_RESTART]})

    def close(self) -> None:
        pass


def _apply(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def _timed(df: DataFrame, at: str, delay: str) -> DataFrame:
    return df.withColumn("_at", V.utc_instant(F.col(at))).withWatermark("_at", delay)


def lockout_stream(logins: DataFrame, delay: str = "1 hour") -> DataFrame:
    return _apply(_timed(logins, "created_at", delay), ["ip"], Lockout(), "id long, ip string, outcome string", "EventTime")


def duplicate_stream(submissions: DataFrame, delay: str = "1 hour") -> DataFrame:
    keyed = _timed(submissions, "created_at", delay).withColumn("key", fingerprint())
    return _apply(keyed, ["key"], DuplicateReuse(), "id long, job_id long", "EventTime")


def job_state_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return _apply(_timed(events, "ts", delay), ["job_id"], JobLifeCycle(),
                  "seq long, job_id long, status string, accepted boolean", "EventTime")


def orphan_stream(events: DataFrame, limit_seconds: int) -> DataFrame:
    """Status of each job after every micro-batch that brings it events, and ``failed`` with
    ``server_restart`` once an open job had none for ``limit_seconds`` of processing time."""
    return _apply(events, ["job_id"], OrphanedJobs(limit_seconds * 1000), "job_id long, status string, error_code string",
                  "ProcessingTime")


def drop_repeats(submissions: DataFrame) -> DataFrame:
    """Cheap approximation of duplicate reuse: one submission per fingerprint within
    ten minutes of event time, whatever its status."""
    keyed = submissions.withColumns({"key": fingerprint(), "_at": V.utc_instant(F.col("created_at"))})
    return keyed.withWatermark("_at", "10 minutes").dropDuplicatesWithinWatermark(["key"]).drop("key", "_at")
