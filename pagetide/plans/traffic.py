"""Queries over page requests and visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import traffic as C
from ..functions import values as V
from ..operators import traffic as T
from ..operators.catalog import TOOL_KEYS
from ..session import store
from .inputs import AS_OF, cte, derived
from .registry import query

# The registered queries keep paths to this length, as their check SQL does.
PATH = C.PATH_MAX_CHARS

# ------------------------------------------------------------- check SQL parts

BOT_SQL = "coalesce(regexp_matches(user_agent, '(?i)" + "|".join(C.BOT_TOKENS) + "'), false)"
_LABELS = " ".join(f"WHEN contains(lower(user_agent), '{t.lower()}') THEN '{n}'" for t, n in C.BOT_LABELS.items())
BOT_NAME_SQL = (f"CASE {_LABELS} WHEN regexp_extract(user_agent, '{C.GENERIC_BOT_PATTERN}', 1, 'i') <> '' "
                f"THEN left(regexp_extract(user_agent, '{C.GENERIC_BOT_PATTERN}', 1, 'i'), 64) ELSE 'Unknown bot' END")
# Patterns of the device classes and marks of the browsers.
_TABLET = r"ipad|tablet|playbook|sm-t\d|gt-p\d|kindle|nexus\s*7|nexus\s*9"
_MOBILE = r"iphone|ipod|android.*mobile|windows phone|blackberry|bb10|mobile|opera mini|iemobile|wpdesktop"
DEVICE_SQL = (f"CASE WHEN regexp_matches(user_agent, '(?i){_TABLET}') THEN 'tablet' "
              f"WHEN regexp_matches(user_agent, '(?i){_MOBILE}') THEN 'mobile' "
              "WHEN coalesce(user_agent, '') = '' THEN 'unknown' ELSE 'desktop' END")
BROWSER_SQL = """CASE WHEN user_agent ILIKE '%edg/%' THEN 'Edge'
  WHEN user_agent ILIKE '%samsungbrowser/%' THEN 'Samsung Internet'
  WHEN user_agent ILIKE '%opr/%' OR user_agent ILIKE '%opera/%' THEN 'Opera'
  WHEN user_agent ILIKE '%firefox/%' OR user_agent ILIKE '%fxios/%' THEN 'Firefox'
  WHEN user_agent ILIKE '%crios/%' OR user_agent ILIKE '%chrome/%' THEN 'Chrome'
  WHEN user_agent ILIKE '%safari/%' AND user_agent ILIKE '%version/%' THEN 'Safari'
  WHEN coalesce(user_agent, '') = '' THEN 'Unknown' ELSE 'Other' END"""
_AUTH = "regexp_replace(regexp_extract(coalesce(referer, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', '')"
HOST_SQL = (f"regexp_replace(lower(CASE WHEN starts_with({_AUTH}, '[') THEN split_part(substr({_AUTH}, 2), ']', 1) "
            f"ELSE split_part({_AUTH}, ':', 1) END), '^www[.]', '')")
_SOURCES = " ".join(f"WHEN contains(host, '{m}') THEN '{n}'" for m, n in C.SOURCE_LABELS.items())
SOURCE_SQL = f"CASE WHEN host = '' THEN 'Direct' {_SOURCES} ELSE host END"
TRUNC_SQL = """CASE WHEN coalesce(ip, '') IN ('', 'unknown') THEN 'unknown'
  WHEN len(string_split(ip, '.')) = 4 THEN regexp_replace(ip, '[.][^.]*$', '.0')
  WHEN len(string_split(ip, ':')) >= 3 THEN concat(split_part(ip, ':', 1), ':', split_part(ip, ':', 2), ':', split_part(ip, ':', 3), '::')
  ELSE 'unknown' END"""
PATHS_SQL = "(path = '/' OR starts_with(path, '/tools/'))"
_NUM = "list_aggregate(list_transform(string_split(ip, '.'), lambda x, i: try_cast(x AS BIGINT) * (256 ** (4 - i))::BIGINT), 'sum')::BIGINT"
GEO_SQL = f"""SELECT q.*, b.country, b.city FROM (SELECT *, CASE WHEN regexp_matches(coalesce(ip, ''), '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN {_NUM} END AS num FROM requests) q
  LEFT JOIN geo_blocks b ON q.num BETWEEN b.ip_start AND b.ip_end"""
VISITS_SQL = f"""SELECT request_id AS id, {TRUNC_SQL} AS ip_trunc, country, city, {DEVICE_SQL} AS device,
  {BROWSER_SQL} AS browser, {SOURCE_SQL} AS source, left(path, 256) AS path, ts AS created_at
  FROM (SELECT *, {HOST_SQL} AS host FROM located) WHERE {PATHS_SQL} AND NOT {BOT_SQL}"""
BOTS_SQL = f"""SELECT request_id AS id, {BOT_NAME_SQL} AS name, country, left(path, 256) AS path, ts AS created_at
  FROM located WHERE {PATHS_SQL} AND {BOT_SQL}"""
SINCE30 = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
SINCE7 = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
VISITS = dict(located=GEO_SQL, visits=VISITS_SQL, bots=BOTS_SQL)
REQ = cte("requests")
ALL = cte("requests", "geo_blocks", "jobs", "logins", **VISITS)


# ------------------------------------------------------------------ inputs

def located(spark, sf):
    return T.geo_lookup(T.tracked_requests(derived(spark, sf, "requests")), derived(spark, sf, "geo_blocks"))


def visits_of(spark, sf):
    return T.to_visits(located(spark, sf), PATH)


def unplaced(spark, sf):
    """Tracked requests for figures that do not need the place."""
    return T.without_geo(T.tracked_requests(derived(spark, sf, "requests")))


# ------------------------------------------------------------ scalar queries

@query("s_is_bot", REQ + f"SELECT user_agent, {BOT_SQL} AS is_bot, count(*) AS n FROM requests GROUP BY ALL")
def s_is_bot(spark, sf):
    return derived(spark, sf, "requests").groupBy(
        "user_agent", C.is_bot(F.col("user_agent")).alias("is_bot")).agg(F.count("*").alias("n"))


@query("s_bot_name", REQ + f"SELECT request_id, {BOT_NAME_SQL} AS name FROM requests WHERE {BOT_SQL}")
def s_bot_name(spark, sf):
    ua = F.col("user_agent")
    return derived(spark, sf, "requests").filter(C.is_bot(ua)).select("request_id", C.bot_name(ua).alias("name"))


@query("s_device", REQ + f"SELECT request_id, {DEVICE_SQL} AS device FROM requests")
def s_device(spark, sf):
    return derived(spark, sf, "requests").select("request_id", C.device(F.col("user_agent")).alias("device"))


@query("s_browser", REQ + f"SELECT request_id, {BROWSER_SQL} AS browser FROM requests")
def s_browser(spark, sf):
    return derived(spark, sf, "requests").select("request_id", C.browser(F.col("user_agent")).alias("browser"))


@query("s_source", REQ + f"SELECT request_id, {SOURCE_SQL} AS source FROM (SELECT *, {HOST_SQL} AS host FROM requests)")
def s_source(spark, sf):
    return derived(spark, sf, "requests").select("request_id", C.source(F.col("referer")).alias("source"))


@query("s_trunc_ip", REQ + f"SELECT request_id, {TRUNC_SQL} AS ip_trunc FROM requests")
def s_trunc_ip(spark, sf):
    return derived(spark, sf, "requests").select("request_id", C.truncate_ip(F.col("ip")).alias("ip_trunc"))


@query("s_client_ip", REQ + """SELECT request_id,
  coalesce(trim(split_part(CASE WHEN edge_ip <> '' THEN edge_ip WHEN forwarded <> '' THEN forwarded END, ',', 1)), 'unknown') AS visit_ip,
  coalesce(trim(split_part(nullif(forwarded, ''), ',', 1)), socket_host, 'unknown') AS api_ip FROM requests""")
def s_client_ip(spark, sf):
    headers = F.create_map(F.lit("CF-Connecting-IP"), F.col("edge_ip"),
                           F.lit("X-Forwarded-For"), F.col("forwarded"))
    return derived(spark, sf, "requests").select(
        "request_id", C.client_ip(headers).alias("visit_ip"),
        C.client_ip(headers, ("x-forwarded-for",), F.col("socket_host")).alias("api_ip"))


_LOC = ", ".join(f"'{s}'" for s in L.LOCALES)
_TAG = f"""CASE WHEN tag IS NULL THEN NULL WHEN lower(tag) LIKE 'zh-tw%' OR lower(tag) LIKE 'zh-hk%' THEN NULL
  WHEN lower(tag) IN ({_LOC}) THEN lower(tag) WHEN split_part(lower(tag), '-', 1) IN ({_LOC}) THEN split_part(lower(tag), '-', 1) END"""


@query("s_locale_match", REQ + f"""SELECT request_id, {_TAG} AS locale,
  CASE WHEN {_TAG} IS NOT NULL THEN {_TAG} WHEN user_id % 2 = 0 THEN 'es' END AS first_locale FROM requests""")
def s_locale_match(spark, sf):
    second = F.when(F.col("user_id") % 2 == 0, "es-MX").otherwise("xx")
    return derived(spark, sf, "requests").select(
        "request_id", L.match_locale(F.col("tag")).alias("locale"),
        L.match_locales(F.array(F.col("tag"), second)).alias("first_locale"))


@query("s_locale_path", REQ + """SELECT request_id, CASE WHEN loc IN ('', 'en', 'xx') THEN path
  WHEN path = '/' THEN concat('/', loc) ELSE concat('/', loc, path) END AS local_path,
  concat('https://site.example', CASE WHEN loc IN ('', 'en', 'xx') THEN path
  WHEN path = '/' THEN concat('/', loc) ELSE concat('/', loc, path) END) AS url
  FROM (SELECT *, CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'zh-cn' ELSE 'xx' END AS loc FROM requests)""")
def s_locale_path(spark, sf):
    loc = F.expr("CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'zh-cn' ELSE 'xx' END")
    return derived(spark, sf, "requests").select(
        "request_id", L.locale_path(F.col("path"), loc).alias("local_path"),
        L.locale_url("https://site.example", F.col("path"), loc).alias("url"))


@query("s_day", REQ + "SELECT request_id, strftime(ts, '%Y-%m-%d') AS date FROM requests")
def s_day(spark, sf):
    return derived(spark, sf, "requests").select("request_id", V.day(F.col("ts")).alias("date"))


@query("s_coalesce", cte("requests", "geo_blocks", "jobs") + """SELECT id, CASE WHEN coalesce(error, '') = '' THEN 'Unknown error' ELSE substr(error, 1, 200) END AS error,
  CASE WHEN coalesce(error, '') = '' THEN '—' ELSE error END AS label FROM jobs""")
def s_coalesce(spark, sf):
    return derived(spark, sf, "jobs").select(
        "id", V.short_error(F.col("error")).alias("error"), V.label_or(F.col("error"), "—").alias("label"))


# ------------------------------------------------------------------ filters

@query("f_track_human", REQ + f"SELECT request_id, path FROM requests WHERE {PATHS_SQL} AND NOT {BOT_SQL}")
def f_track_human(spark, sf):
    return derived(spark, sf, "requests").filter(C.track_human(F.col("path"), F.col("user_agent"))).select("request_id", "path")


@query("f_track_bot", REQ + f"SELECT request_id, path FROM requests WHERE {PATHS_SQL} AND {BOT_SQL}")
def f_track_bot(spark, sf):
    return derived(spark, sf, "requests").filter(C.track_bot(F.col("path"), F.col("user_agent"))).select("request_id", "path")


@query("f_window", ALL + f"""SELECT 7 AS days, id, created_at FROM visits WHERE {SINCE7}
  UNION ALL SELECT 1, id, created_at FROM visits WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY
  UNION ALL SELECT 90, id, created_at FROM visits WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""")
def f_window(spark, sf):
    visits, out = T.to_visits(unplaced(spark, sf), PATH), None
    for asked in (7, 0, 500):
        days = T.clamp_days(asked, high=90)
        part = T.since(visits, AS_OF, days).select(F.lit(days).alias("days"), "id", "created_at")
        out = part if out is None else out.unionByName(part)
    return out


_PAGES = ", ".join(f"'{p}'" for p in L.TOP_PAGES)
_PRE = ", ".join(f"'{p}'" for p in L.PREFIXED_LOCALES)
_SLUG = ", ".join(f"'{p}'" for p in TOOL_KEYS)


@query("f_known_route", REQ + f"""SELECT request_id, path FROM (SELECT *, trim(path, '/') AS norm FROM requests) WHERE
  norm = '' OR norm IN ({_PAGES}) OR norm IN ({_PRE})
  OR (regexp_matches(norm, '^tools/[^/]*$') AND split_part(norm, '/', 2) IN ({_SLUG}))
  OR (regexp_matches(norm, '^[^/]+/[^/]*$') AND split_part(norm, '/', 1) IN ({_PRE}) AND split_part(norm, '/', 2) IN ({_PAGES}))
  OR (regexp_matches(norm, '^[^/]+/tools/[^/]*$') AND split_part(norm, '/', 1) IN ({_PRE}) AND split_part(norm, '/', 3) IN ({_SLUG}))""")
def f_known_route(spark, sf):
    return derived(spark, sf, "requests").filter(L.is_known_route(F.col("path"), TOOL_KEYS)).select("request_id", "path")


@query("f_retention", ALL + f"""SELECT 'visits' AS tbl, count(*) AS kept, min(created_at) AS oldest FROM visits WHERE {SINCE7}
  UNION ALL SELECT 'bot_visits', count(*), min(created_at) FROM bots WHERE {SINCE7}
  UNION ALL SELECT 'logins', count(*), min(created_at) FROM logins WHERE created_at >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 7 DAY
  UNION ALL SELECT 'quotas', count(*), min(h) FROM (SELECT DISTINCT tool, date_trunc('hour', created_at) AS h FROM jobs)
    WHERE h >= TIMESTAMP '2024-01-30 22:30:00' - INTERVAL 2 HOUR""")
def f_retention(spark, sf):
    quotas = derived(spark, sf, "jobs").select("tool", V.hour_start(F.col("created_at")).alias("created_at")).distinct()
    tracked = unplaced(spark, sf)
    kept = {
        "visits": T.keep_recent(T.to_visits(tracked, PATH), AS_OF, days=7),
        "bot_visits": T.keep_recent(T.to_bot_visits(tracked, PATH), AS_OF, days=7),
        "logins": T.keep_recent(derived(spark, sf, "logins"), "2024-01-08 00:00:00", days=7),
        "quotas": T.keep_recent(quotas, "2024-01-30 22:30:00", hours=2),
    }
    out = None
    for name, df in kept.items():
        part = df.agg(F.count("*").alias("kept"), F.min("created_at").alias("oldest")).select(
            F.lit(name).alias("tbl"), "kept", "oldest")
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------------------------- geo

@query("j_geo_range", cte("requests", "geo_blocks", located=GEO_SQL) + "SELECT request_id, ip, country, city FROM located")
def j_geo_range(spark, sf):
    return T.geo_lookup(derived(spark, sf, "requests"), derived(spark, sf, "geo_blocks")).select(
        "request_id", "ip", "country", "city")


# -------------------------------------------------------------- aggregates

@query("a_totals", ALL + f"""SELECT (SELECT count(*) FROM visits WHERE {SINCE30}) AS total_visits,
  (SELECT count(DISTINCT ip_trunc) FROM visits WHERE {SINCE30}) AS unique_visitors,
  (SELECT count(*) FROM bots WHERE {SINCE30}) AS bot_hits""")
def a_totals(spark, sf):
    tracked = T.since(unplaced(spark, sf), AS_OF, 30, "ts")
    return T.totals(tracked)


@query("a_unique", ALL + f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, count(DISTINCT ip_trunc) AS unique_visitors
  FROM visits WHERE {SINCE30} GROUP BY 1""")
def a_unique(spark, sf):
    return T.since(T.to_visits(unplaced(spark, sf), PATH), AS_OF, 30).groupBy(V.day(F.col("created_at")).alias("date")).agg(
        F.count_distinct("ip_trunc").alias("unique_visitors"))


@query("a_unique_sketch", ALL + f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, count(DISTINCT ip_trunc) AS unique_visitors, true AS close
  FROM visits WHERE {SINCE30} GROUP BY 1
  UNION ALL SELECT 'all', count(DISTINCT ip_trunc), true FROM visits WHERE {SINCE30}""")
def a_unique_sketch(spark, sf):
    """Exact visitors of each day, and of all days together, and whether the estimate from the stored
    daily sketches is within 2 % of it (or one visitor)."""
    visits = T.since(T.to_visits(unplaced(spark, sf), PATH), AS_OF, 30)
    # Six standard errors: at the default sketch width 2 % are one and a half, which days exceed by chance.
    stored = store(T.approximate_uniques(visits, 0.02 / 6), "sketches")
    exact = visits.groupBy(V.day(F.col("created_at")).alias("date")).agg(
        F.count_distinct("ip_trunc").alias("unique_visitors"))
    every = visits.agg(F.count_distinct("ip_trunc").alias("unique_visitors")).select(F.lit("all").alias("date"), "unique_visitors")
    estimates = stored.select("date", F.hll_sketch_estimate("visitors").alias("estimate")).union(
        T.unique_over(stored).select(F.lit("all"), "unique_visitors"))
    n = F.col("unique_visitors")
    near = F.abs(F.coalesce("estimate", F.lit(0)) - n) <= F.greatest(F.lit(1.0), n * 0.02)
    return exact.union(every).join(estimates, "date").select(
        "date", "unique_visitors", near.alias("close"))


def _top_sql(table, column, k, where="true", name="name"):
    return (f"SELECT CASE WHEN coalesce({column}, '') = '' THEN 'Unknown' ELSE {column} END AS {name}, n AS count FROM "
            f"(SELECT {column}, count(*) AS n FROM {table} WHERE {SINCE30} AND {where} GROUP BY {column} "
            f"ORDER BY n DESC, {column} ASC NULLS FIRST LIMIT {k})")


_TOPS = [("bot_name", "bots", "name", 10, "true"), ("bot_country", "bots", "country", 10, "true"),
         ("completions", "jobs", "tool", 20, "status = 'succeeded'"),
         ("failures", "jobs", "tool", 20, "status = 'failed'")]


@query("a_top_dim", ALL + " UNION ALL ".join(
    f"SELECT '{label}' AS list, * FROM ({_top_sql(t, c, k, w)})" for label, t, c, k, w in _TOPS))
def a_top_dim(spark, sf):
    tables = {"bots": T.to_bot_visits(located(spark, sf), PATH), "jobs": derived(spark, sf, "jobs")}
    out = None
    for label, table, column, k, where in _TOPS:
        top = T.top_by(T.since(tables[table], AS_OF, 30).filter(F.expr(where)), column, k)
        part = top.select(F.lit(label).alias("list"), "name", "count")
        out = part if out is None else out.unionByName(part)
    return out


@query("o_topk", ALL + _top_sql("visits", "browser", 10))
def o_topk(spark, sf):
    return T.top_by(T.since(T.to_visits(unplaced(spark, sf), PATH), AS_OF, 30), "browser", 10)


@query("a_dashboard_1pass", ALL + " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, rank, CASE WHEN coalesce(raw, '') = '' THEN 'Unknown' ELSE raw END AS name, n AS count FROM
    (SELECT {d} AS raw, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {d} ASC NULLS FIRST) AS rank
     FROM visits WHERE {SINCE30} GROUP BY {d}) WHERE rank <= 10""" for d in T.VISIT_DIMENSIONS))
def a_dashboard_1pass(spark, sf):
    return T.dashboard_breakdowns(T.since(visits_of(spark, sf), AS_OF, 30))


_DAILY = f"SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count FROM visits WHERE {SINCE30} GROUP BY 1"


@query("a_by_day", ALL + _DAILY)
def a_by_day(spark, sf):
    return T.by_day(T.since(T.to_visits(unplaced(spark, sf), PATH), AS_OF, 30))


@query("a_day_scale", ALL + f"SELECT date, count, round(greatest(count * 100.0::DOUBLE / greatest((SELECT max(count) FROM d), 1), 4.0), 2) AS bar_percent FROM d".replace("FROM d)", f"FROM ({_DAILY}))").replace("FROM d", f"FROM ({_DAILY})"))
def a_day_scale(spark, sf):
    return T.scale_days(T.by_day(T.since(T.to_visits(unplaced(spark, sf), PATH), AS_OF, 30)))


def _ranked(table, column, where):
    return f"""(SELECT coalesce(string_agg(name || '=' || n, '; ' ORDER BY n DESC, name), '') FROM
    (SELECT CASE WHEN coalesce({column}, '') = '' THEN 'Unknown' ELSE {column} END AS name, n FROM
    (SELECT {column}, count(*) AS n FROM {table} WHERE {SINCE7} AND {where} GROUP BY {column}
     ORDER BY n DESC, {column} ASC NULLS FIRST LIMIT 5)))"""


@query("a_digest", ALL + f"""SELECT (SELECT count(*) FROM visits WHERE {SINCE7}) AS visits,
  (SELECT count(DISTINCT ip_trunc) FROM visits WHERE {SINCE7}) AS unique_visitors,
  (SELECT count(*) FROM bots WHERE {SINCE7}) AS bot_hits,
  {_ranked('jobs', 'tool', "status = 'succeeded'")} AS top_tools,
  {_ranked('jobs', 'tool', "status = 'failed'")} AS failures,
  {_ranked('visits', 'country', 'true')} AS top_countries""")
def a_digest(spark, sf):
    seen = T.since(located(spark, sf), AS_OF, 7, "ts")
    return T.digest(seen, T.since(derived(spark, sf, "jobs"), AS_OF, 7))


@query("o_recent", ALL + f"""SELECT 'visit' AS kind, CAST(id AS VARCHAR) AS id, created_at,
    concat_ws('|', ip_trunc, CASE WHEN coalesce(country, '') = '' THEN 'Unknown' ELSE country END,
      CASE WHEN coalesce(city, '') = '' THEN '—' ELSE city END, device, browser, source, path) AS detail
    FROM (SELECT * FROM visits ORDER BY created_at DESC, id LIMIT 20)
  UNION ALL SELECT 'job', id, created_at, tool FROM (SELECT * FROM jobs ORDER BY created_at DESC, id LIMIT 10)
  UNION ALL SELECT 'failure', id, created_at, concat_ws('|', tool, CASE WHEN coalesce(error, '') = '' THEN 'Unknown error' ELSE left(error, 200) END)
    FROM (SELECT * FROM jobs WHERE status = 'failed' AND {SINCE30} ORDER BY created_at DESC, id LIMIT 10)
  UNION ALL SELECT 'login', CAST(id AS VARCHAR), created_at, username FROM (SELECT * FROM logins ORDER BY created_at DESC, id LIMIT 200)""")
def o_recent(spark, sf):
    def rows(kind, df, detail):
        return df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "created_at", detail.alias("detail"))

    jobs = derived(spark, sf, "jobs")
    shown = ("ip", "country", "city", "device", "browser", "source", "path")
    parts = [
        rows("visit", T.recent_visits(T.tracked_requests(derived(spark, sf, "requests")), derived(spark, sf, "geo_blocks"), path_chars=PATH), F.concat_ws("|", *shown)),
        rows("job", T.newest(jobs, 10), F.col("tool")),
        rows("failure", T.recent_failures(T.since(jobs, AS_OF, 30)), F.concat_ws("|", "tool", "error")),
        rows("login", T.newest(derived(spark, sf, "logins"), T.clamp_limit(5000, high=200)), F.col("username")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------------ export

@query("snk_csv", ALL + f"""SELECT 'visits' AS export, concat_ws(',', ip_trunc, coalesce(country, ''), coalesce(city, ''), device, browser, source, path) AS fields, created_at FROM visits WHERE {SINCE7}
  UNION ALL SELECT 'bots', concat_ws(',', name, coalesce(country, ''), path), created_at FROM bots WHERE {SINCE7}
  UNION ALL SELECT 'logins', concat_ws(',', username, CASE WHEN success THEN 'True' ELSE 'False' END), created_at FROM logins WHERE created_at >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 7 DAY
  UNION ALL SELECT 'jobs', concat_ws(',', tool, status, left(coalesce(error, ''), 200)), created_at FROM jobs WHERE {SINCE7}""")
def snk_csv(spark, sf):
    seen = T.since(located(spark, sf), AS_OF, 7, "ts")
    inputs = {
        "visits": T.to_visits(seen, PATH),
        "bots": T.to_bot_visits(seen, PATH),
        "logins": T.since(derived(spark, sf, "logins"), "2024-01-08 00:00:00", 7),
        "jobs": T.since(derived(spark, sf, "jobs"), AS_OF, 7),
    }
    out = None
    for name, df in inputs.items():
        view = T.export_view(name, df)
        fields = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in view.columns if c != "created_at"])
        part = view.select(F.lit(name).alias("export"), fields.alias("fields"), "created_at")
        out = part if out is None else out.unionByName(part)
    return out
