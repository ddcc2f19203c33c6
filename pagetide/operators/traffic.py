"""Page-view analytics: classify, route, aggregate, export."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import traffic as C
from ..functions import values as V
from .skew import SALTS

VISIT_DIMENSIONS = ("country", "city", "device", "browser", "source", "path")


def as_of_column(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def clamp_days(days: int, low: int = 1, high: int | None = None) -> int:
    """``days``, at least ``low`` and, where the caller sets a bound, at most ``high``."""
    return max(low, days if high is None else min(days, high))


def since(df: DataFrame, as_of: datetime | str, days: int, column: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days; the bound is a literal, so it reaches the scan."""
    return df.filter(F.col(column) >= as_of_column(as_of) - F.make_dt_interval(F.lit(days)))


def keep_recent(df: DataFrame, as_of: datetime | str, *, days: int = 0, hours: int = 0,
                column: str = "created_at") -> DataFrame:
    """Retention: what lies strictly before the cut-off goes."""
    return df.filter(F.col(column) >= as_of_column(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours)))


# ---------------------------------------------------------------- geography

def _covered_prefixes(blocks: DataFrame) -> DataFrame:
    """Blocks repeated for every /16 they touch; non-overlapping blocks touch at most
    65,536 + (number of blocks) of them in total."""
    return blocks.withColumn(
        "_prefix",
        F.explode(F.sequence(F.shiftright("ip_start", 16), F.shiftright("ip_end", 16))),
    )


def geo_lookup(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Left range join of IPv4 addresses to non-overlapping address blocks.

    The /16 prefix is the equi key, with a row-spread salt, as many as the shuffle is wide (at
    most SALTS), that splits hot prefixes; rows without an IPv4 address get private prefixes.
    Where the block table turns out small, adaptive execution sends it round and the requests
    do not move.
    """
    salts = min(SALTS, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = requests.withColumn("_ip", C.ipv4_number(F.col("ip")))
    prefix = F.shiftright(F.col("_ip"), 16)
    ranges = _covered_prefixes(blocks).select("_prefix", "ip_start", "ip_end", "country", "city")
    nowhere = -1 - F.pmod(F.xxhash64("request_id"), F.lit(65536))
    facts = facts.withColumns({"_prefix": F.coalesce(prefix, nowhere),
                               "_salt": F.pmod(F.xxhash64("request_id"), F.lit(salts))})
    ranges = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    same = (facts["_prefix"] == ranges["_prefix"]) & (facts["_salt"] == ranges["_salt"])
    hit = same & facts["_ip"].between(ranges["ip_start"], ranges["ip_end"])
    return facts.join(ranges, hit, "left").select(
        *[facts[c] for c in requests.columns], ranges["country"], ranges["city"]
    )


def without_geo(requests: DataFrame) -> DataFrame:
    """Unknown place for every request: what a missing block table gives."""
    none = F.lit(None).cast("string")
    return requests.withColumns({"country": none, "city": none})


# ------------------------------------------------------------ classification

def tracked_requests(requests: DataFrame) -> DataFrame:
    """Page views worth recording, with the bot flag."""
    return requests.filter(C.is_tracked_path(F.col("path"))).withColumn("is_bot", C.is_bot(F.col("user_agent")))


def _path(chars: int | None) -> Column:
    return F.col("path") if chars is None else F.left("path", F.lit(chars)).alias("path")


def to_visits(tracked: DataFrame, path_chars: int | None = None) -> DataFrame:
    """Human page views as visit rows. Needs ``country`` and ``city`` (see geo_lookup). Paths are
    whole unless the caller bounds them."""
    ua = F.col("user_agent")
    return tracked.filter(~F.col("is_bot")).select(
        F.col("request_id").alias("id"),
        C.truncate_ip(F.col("ip")).alias("ip_trunc"),
        "country", "city",
        C.device(ua).alias("device"),
        C.browser(ua).alias("browser"),
        C.source(F.col("referer")).alias("source"),
        _path(path_chars),
        F.col("ts").alias("created_at"),
    )


def to_bot_visits(tracked: DataFrame, path_chars: int | None = None) -> DataFrame:
    return tracked.filter(F.col("is_bot")).select(
        F.col("request_id").alias("id"),
        C.bot_name(F.col("user_agent")).alias("name"),
        "country",
        _path(path_chars),
        F.col("ts").alias("created_at"),
    )


# --------------------------------------------------------------- aggregates

def totals(tracked: DataFrame) -> DataFrame:
    """One row: visits, distinct truncated addresses, bot hits; from one scan of the tracked
    requests (see tracked_requests)."""
    human = ~F.col("is_bot")
    return tracked.agg(
        F.count_if(human).alias("total_visits"),
        F.count_distinct(F.when(human, C.truncate_ip(F.col("ip")))).alias("unique_visitors"),
        F.count_if(F.col("is_bot")).alias("bot_hits"))


def approximate_uniques(visits: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Per-day sketches of the visitors: small, and mergeable over any span of days. ``rsd`` is the
    standard error of an estimate, also of merged days; a sketch has
    (1.04 / rsd) ** 2 registers or more."""
    log_registers = min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))
    sketched = visits.groupBy(V.day(F.col("created_at")).alias("date")).agg(
        F.hll_sketch_agg("ip_trunc", F.lit(log_registers)).alias("visitors"))
    return sketched.withColumn("visitors_estimate", F.hll_sketch_estimate("visitors"))


def unique_over(sketches: DataFrame) -> DataFrame:
    """One row: estimated visitors over all days of ``sketches`` (see approximate_uniques), from the
    sketches alone. Visitors of several days count once."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("unique_visitors"))


def top_by(df: DataFrame, column: str, k: int, label: str = "Unknown") -> DataFrame:
    """Top-k by count. Groups on the raw value; null and '' are labelled afterwards."""
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first(column)).limit(k)
        .select(V.label_or(F.col(column), label).alias("name"), F.col("n").alias("count"))
    )


def dashboard_breakdowns(visits: DataFrame, k: int = 10,
                         dimensions: tuple[str, ...] = VISIT_DIMENSIONS) -> DataFrame:
    """Top-k of every dimension from one scan, by grouping sets.

    The rank filter is a top-k the planner also applies before the shuffle.
    """
    counted = visits.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set")
    )
    width = len(dimensions)
    dimension, raw = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        mine = F.col("_set") == ((1 << width) - 1 - (1 << (width - 1 - i)))
        dimension = F.when(mine, F.lit(d)).otherwise(dimension)
        raw = F.when(mine, F.col(d)).otherwise(raw)
    named = counted.select(dimension.alias("dimension"), raw.alias("_raw"), "n")
    rank = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc_nulls_first("_raw"))
    return (
        named.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
        .select("dimension", "rank", V.label_or(F.col("_raw"), "Unknown").alias("name"),
                F.col("n").alias("count"))
    )


def by_day(visits: DataFrame) -> DataFrame:
    return visits.groupBy(V.day(F.col("created_at")).alias("date")).agg(F.count(F.lit(1)).alias("count"))


def fill_days(daily: DataFrame) -> DataFrame:
    """Add the missing days between the first and the last, with count 0."""
    days = daily.agg(F.explode(F.sequence(F.to_date(F.min("date")), F.to_date(F.max("date")))).alias("d"))
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("date")).join(daily, "date", "left").fillna(0, ["count"])


def scale_days(daily: DataFrame) -> DataFrame:
    """Each day relative to the busiest one, in whole percent, at least 4.

    The input is one row per day, so the unpartitioned window is tiny.
    """
    busiest = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    percent = F.greatest(F.col("count") * 100.0 / busiest, F.lit(4.0))
    return daily.withColumn("bar_percent", F.round(percent, 2))


def digest(located: DataFrame, jobs: DataFrame, k: int = 5) -> DataFrame:
    """One row of weekly figures and short ranked lists (already filtered inputs).

    ``located`` are tracked requests with place: one scan, grouped by country and in all, gives
    the figures and the countries. The jobs are counted once by status and tool.
    """
    human = ~F.col("is_bot")
    by_country = located.groupingSets([["country"], []], "country").agg(
        F.grouping_id().alias("_all"), F.count_if(human).alias("visits"),
        F.count_distinct(F.when(human, C.truncate_ip(F.col("ip")))).alias("unique_visitors"),
        F.count_if(F.col("is_bot")).alias("bot_hits"))
    lists = by_country.filter("_all = 0 AND visits > 0").select(
        F.lit("top_countries").alias("section"), F.col("country").alias("raw"), F.col("visits").alias("n"))
    section = F.when(F.col("status") == "succeeded", "top_tools").when(F.col("status") == "failed", "failures")
    lists = lists.unionByName(jobs.groupBy(section.alias("section"), F.col("tool").alias("raw")).agg(
        F.count(F.lit(1)).alias("n")).filter("section IS NOT NULL"))
    first = Window.partitionBy("section").orderBy(F.desc("n"), F.asc_nulls_first("raw"))
    top = lists.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).select(
        "section", V.label_or(F.col("raw"), "Unknown").alias("name"), "n")
    shown = Window.partitionBy("section").orderBy(F.desc("n"), "name")
    top = top.select("section", F.row_number().over(shown).alias("rank"),
                     F.concat_ws("=", "name", F.col("n").cast("string")).alias("item"))
    figures = by_country.filter("_all = 1").select(F.explode(F.create_map(*[
        c for n in ("visits", "unique_visitors", "bot_hits") for c in (F.lit(n), F.col(n))])).alias("section", "value")
    ).select("section", F.lit(1).alias("rank"), F.col("value").cast("string").alias("item"))
    rows = figures.unionByName(top)

    def figure(name: str) -> Column:
        return F.max(F.when(F.col("section") == name, F.col("item"))).cast("long").alias(name)

    def ranked_list(name: str) -> Column:
        items = F.collect_list(F.when(F.col("section") == name, F.struct("rank", "item")))
        return F.array_join(F.transform(F.array_sort(items), lambda s: s["item"]), "; ").alias(name)

    return rows.agg(
        *[figure(n) for n in ("visits", "unique_visitors", "bot_hits")],
        *[ranked_list(n) for n in ("top_tools", "failures", "top_countries")],
    )


def newest(df: DataFrame, n: int, column: str = "created_at", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows: a top-k, not a global sort."""
    return df.orderBy(F.desc(column), tie).limit(n)


def clamp_limit(n: int, low: int = 1, high: int | None = None) -> int:
    """``n``, at least ``low`` and, where the caller sets a bound, at most ``high``."""
    return max(low, n if high is None else min(n, high))


def recent_visits(tracked: DataFrame, blocks: DataFrame, n: int = 20, path_chars: int | None = None) -> DataFrame:
    """The newest visits; on purpose without a time bound. Only these are located and classified."""
    few = newest(tracked.filter(~F.col("is_bot")), n, "ts", "request_id")
    return to_visits(geo_lookup(few, blocks), path_chars).select(
        "id", "created_at", F.col("ip_trunc").alias("ip"),
        V.label_or(F.col("country"), "Unknown").alias("country"),
        V.label_or(F.col("city"), "—").alias("city"),
        "device", "browser", "source", "path",
    )


def recent_failures(jobs: DataFrame, n: int = 10) -> DataFrame:
    failed = newest(jobs.filter(F.col("status") == "failed"), n)
    return failed.select("id", "tool", V.short_error(F.col("error")).alias("error"), "created_at")


# ------------------------------------------------------------------ exports

def export_view(table: str, df: DataFrame) -> DataFrame:
    """Columns of one CSV export, in order (rows are ordered by the writer)."""
    # The columns and their order.
    if table == "visits":
        return df.select("created_at", F.col("ip_trunc").alias("ip_truncated"), "country", "city",
                         "device", "browser", "source", "path")
    if table == "bots":
        return df.select("created_at", F.col("name").alias("bot_name"), "country", "path")
    if table == "logins":
        return df.select("created_at", "username", F.initcap(F.col("success").cast("string")).alias("success"))
    if table == "jobs":
        return df.select("created_at", "tool", "status",
                         F.left(F.coalesce("error", F.lit("")), F.lit(200)).alias("error"))
    raise ValueError(f"unknown export: {table}")


def export_csv(table: str, df: DataFrame, as_of: datetime | str, path: str,
               days: int = S.RETENTION_DAYS) -> None:
    """Write one export, newest first. The range sort keeps the write parallel."""
    view = export_view(table, since(df, as_of, days)).orderBy(F.desc("created_at"))
    view.write.mode("overwrite").option("header", True).csv(path)
