"""A table that micro-batches write: idempotent commits, bounded files, retention by day.

Every batch is written to a folder of its own, partitioned by day, and counts only once a new
version of the manifest lists it; a batch that is run again finds itself listed and changes
nothing. Entries have levels: as soon as ``FANOUT`` entries of one level stand beside each other they
are merged into one of the next level, so after n batches at most ``FANOUT`` entries a level, and
log n levels, are live. With keys, merging keeps each key's newest row. Days past the retention
time are left out when reading, their folders removed at the next commit.

A version is one small file, made by renaming, which fails if the version exists: of two writers
one loses. Files of a version stay until the next but one, for readers that still use it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT = 10
BATCH = "_batch"


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, day: str, keys: list[str] | None = None,
                 retention_days: int | None = None, fanout: int = FANOUT):
        """``day`` names a date column; ``keys`` (with ``day`` among them or not) make it an upsert."""
        self.spark, self.path, self.day, self.keys = spark, path.rstrip("/"), day, keys
        self.retention_days, self.fanout = retention_days, fanout
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- manifest

    def _versions(self) -> list[int]:
        where = self._at(f"{self.path}/manifest")
        if not self._fs.exists(where):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(where) if f.getPath().getName().isdigit())

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "entries": [], "sequence": 0, "last_batch": {}, "newest": None, "gone": [], "schema": None}
        stream = self._fs.open(self._at(f"{self.path}/manifest/{versions[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        state["version"] += 1
        draft, final = self._at(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest/{state['version']}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer made version {state['version']} of {self.path}")
        for old in self._versions()[:-2]:
            self._fs.delete(self._at(f"{self.path}/manifest/{old}"), False)

    # --------------------------------------------------------------- writing

    def _write(self, rows: DataFrame, name: str) -> tuple[str, list[str]]:
        """Few files a day: adaptive execution joins small shuffle parts and splits those of a large day."""
        folder = f"{name}-{uuid.uuid4().hex}"
        target = f"{self.path}/{folder}"
        rows.withColumn("_day", F.date_format(self.day, "yyyy-MM-dd")).hint("rebalance", "_day").write.partitionBy("_day").parquet(target)
        days = [f.getPath().getName().removeprefix("_day=") for f in self._fs.listStatus(self._at(target)) if f.isDirectory()]
        return folder, sorted(days)

    def commit(self, rows: DataFrame, batch_id: int, newest: dt.datetime | None = None, writer: str = "") -> bool:
        """Add a batch; false if it was there already. ``writer`` names the stream whose batches are
        counted (its checkpoint). ``newest`` moves the clock of the retention time (never back)."""
        state = self.manifest()
        if batch_id <= state["last_batch"].get(writer, -1):
            return False
        state["sequence"] += 1
        doomed, state["gone"] = state["gone"], []
        folder, days = self._write(rows.withColumn(BATCH, F.lit(state["sequence"]).cast("long")), f"batch-{state['sequence']}")
        state["schema"] = rows.schema.json()
        if days:
            state["entries"].append({"folder": folder, "level": 0, "days": days})
        else:
            state["gone"].append(folder)
        state["last_batch"][writer] = batch_id
        if newest is not None:
            state["newest"] = max(filter(None, (state["newest"], newest.isoformat(sep=" "))))
        self._expire(state)
        self._merge(state)
        self._publish(state)
        for name in doomed:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)
        return True

    def cutoff(self, state: dict) -> str | None:
        """First moment kept."""
        if self.retention_days is None or state["newest"] is None:
            return None
        return (dt.datetime.fromisoformat(state["newest"]) - dt.timedelta(days=self.retention_days)).isoformat(sep=" ")

    def _expire(self, state: dict) -> None:
        first = (self.cutoff(state) or "")[:10]
        for entry in state["entries"]:
            state["gone"] += [f"{entry['folder']}/_day={d}" for d in entry["days"] if d < first]
            entry["days"] = [d for d in entry["days"] if d >= first]
        state["gone"] += [e["folder"] for e in state["entries"] if not e["days"]]
        state["entries"] = [e for e in state["entries"] if e["days"]]

    def _merge(self, state: dict) -> None:
        while True:
            levels = [e["level"] for e in state["entries"]]
            full = [n for n in set(levels) if levels.count(n) >= self.fanout]
            if not full:
                return
            level = min(full)
            olds = [e for e in state["entries"] if e["level"] == level]
            folder, days = self._write(self._latest(self._rows(olds, state)), f"level-{level + 1}")
            at = state["entries"].index(olds[0])
            state["entries"] = [e for e in state["entries"] if e["level"] != level]
            state["entries"].insert(at, {"folder": folder, "level": level + 1, "days": days})
            state["gone"] += [e["folder"] for e in olds]

    # --------------------------------------------------------------- reading

    def _rows(self, entries: list[dict], state: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"])).add(BATCH, "long")
        folders = [f"{self.path}/{e['folder']}/_day={d}" for e in entries for d in e["days"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _latest(self, rows: DataFrame) -> DataFrame:
        if self.keys is None:
            return rows
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row")).select(*self.keys, "_row.*")

    def read(self, days: list[str] | None = None) -> DataFrame:
        """The current rows, or those of some days; only folders of these days are opened."""
        state = self.manifest()
        if state["schema"] is None:
            raise FileNotFoundError(f"no batch has been committed to {self.path}")
        entries = state["entries"]
        if days is not None:
            entries = [{**e, "days": [d for d in e["days"] if d in days]} for e in entries]
        rows = self._latest(self._rows(entries, state))
        cutoff = self.cutoff(state)
        if cutoff is not None:
            rows = rows.where(F.col(self.day) >= F.lit(cutoff).cast(rows.schema[self.day].dataType))
        return rows.drop(BATCH)
