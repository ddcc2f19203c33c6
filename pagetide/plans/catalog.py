"""Queries over the tool catalog, routes and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locales as L
from ..operators import catalog as C
from .inputs import source
from .registry import query

_PRESENT = ("en", "fr", "es", "ar", "tlh")
_EN = """CASE p_partkey % 8 WHEN 0 THEN 'Hello {name}, you have {count, plural, one {# file} other {# files}}'
  WHEN 1 THEN 'Click <b>here</b> to open {file}' WHEN 2 THEN p_name WHEN 3 THEN concat('https://example.com/', p_size)
  WHEN 4 THEN 'up to 50 MB' WHEN 5 THEN '' WHEN 6 THEN 'PDF' ELSE concat('Item ', p_partkey) END"""
_OTHER = """CASE (p_partkey * 3 + n) % 8 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN en WHEN 3 THEN '{other} text'
  WHEN 4 THEN concat('x ', en) WHEN 5 THEN 'plain words' WHEN 6 THEN concat(en, ' {extra}') ELSE concat('y ', replace(en, '<b>', '')) END"""

_MESSAGES = f"""WITH base AS (SELECT *, {_EN} AS en FROM part), wide AS (SELECT locale, n, p_partkey, en FROM base, (VALUES ('en', 0), ('fr', 1), ('es', 2), ('ar', 3), ('tlh', 4)) v(locale, n)),
  messages AS (SELECT * FROM (SELECT locale, concat('k', p_partkey) AS key, CASE WHEN locale = 'en' THEN en ELSE {_OTHER} END AS value FROM wide) WHERE value IS NOT NULL
    UNION ALL SELECT locale, concat('x', p_partkey), en FROM wide WHERE locale <> 'en' AND p_partkey % 50 = n),
  facts AS (SELECT locale, key, value, list_sort(list_distinct(regexp_extract_all(value, '\\{{([a-zA-Z0-9_]+)[,}}]', 1))) AS vars,
    list_sort(list_distinct(regexp_extract_all(value, '<([a-zA-Z][a-zA-Z0-9]*)>', 1))) AS tags, regexp_extract(value, '\\{{([a-zA-Z0-9_]+),\\s*plural', 1) AS plural,
    trim(value) <> '' AND (regexp_matches(trim(value), '^https?://') OR regexp_full_match(trim(value), '[a-z0-9_./-]+') OR trim(value) IN ('PDF', 'ZIP', 'OCR', 'EXIF', 'GPS', 'XMP', 'C2PA', 'Bates')
      OR (regexp_full_match(trim(value), '(?i)[A-Z0-9 _/().,%°×→-]+') AND regexp_matches(trim(value), '(?i)pdf|mb|kb|dpi'))) AS neutral FROM messages),
  problems AS (SELECT v.locale, e.key, 'missing' AS problem FROM facts e, (VALUES ('fr'), ('es'), ('ar'), ('tlh')) v(locale) WHERE e.locale = 'en' AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.locale = v.locale AND m.key = e.key)
    UNION ALL SELECT t.locale, t.key, 'extra' FROM facts t WHERE t.locale <> 'en' AND t.key NOT IN (SELECT key FROM messages WHERE locale = 'en')
    UNION ALL SELECT locale, key, unnest(list_filter([CASE WHEN blank AND trim(en) <> '' THEN 'empty' END, CASE WHEN NOT blank AND NOT neutral AND broken THEN 'broken' END, CASE WHEN NOT blank AND same AND NOT neutral THEN 'untranslated' END], lambda x: x IS NOT NULL))
      FROM (SELECT t.locale, t.key, e.value AS en, trim(t.value) = '' AS blank, e.neutral, t.value = e.value AS same,
        e.vars <> t.vars OR NOT list_has_all(t.tags, e.tags) OR (e.plural <> '' AND t.plural <> e.plural) AS broken FROM facts t JOIN facts e ON e.key = t.key AND e.locale = 'en' WHERE t.locale <> 'en'))
"""


def messages(spark, sf):
    base = source(spark, sf, "part").withColumn("en", F.expr(_EN))
    pairs = F.array(*[F.struct(F.lit(loc).alias("locale"), F.lit(i).alias("n")) for i, loc in enumerate(_PRESENT)])
    wide = base.select("p_partkey", "en", F.inline(pairs))
    value = F.when(F.col("locale") == "en", F.col("en")).otherwise(F.expr(_OTHER))
    told = wide.select("locale", F.concat(F.lit("k"), "p_partkey").alias("key"), value.alias("value")).filter("value IS NOT NULL")
    extra = wide.filter("locale <> 'en' AND p_partkey % 50 = n").select(
        "locale", F.concat(F.lit("x"), "p_partkey").alias("key"), F.col("en").alias("value"))
    return told.unionByName(extra)


def problems(spark, sf):
    told = messages(spark, sf)
    return C.check_translations(told, told.select("locale"))


@query("j_translations", _MESSAGES + "SELECT * FROM problems")
def j_translations(spark, sf):
    return problems(spark, sf)


@query("a_locale_cov", _MESSAGES + """SELECT v.locale, total - absent AS present, total, round((total - absent) * 100.0::DOUBLE / total, 1) AS percent FROM (VALUES ('fr'), ('es'), ('ar'), ('tlh')) v(locale),
  (SELECT count(*) AS total FROM messages WHERE locale = 'en'), LATERAL (SELECT count(*) AS absent FROM problems p WHERE p.locale = v.locale AND problem IN ('missing', 'empty'))""")
def a_locale_cov(spark, sf):
    told = messages(spark, sf)
    return C.locale_coverage(told, problems(spark, sf), told.select("locale"))


@query("o_sample_list", _MESSAGES + """SELECT locale, problem, string_agg(key, ',' ORDER BY key) AS keys FROM
  (SELECT *, row_number() OVER (PARTITION BY locale, problem ORDER BY key) AS r FROM problems) WHERE r <= CASE problem WHEN 'untranslated' THEN 20 WHEN 'extra' THEN 10 WHEN 'empty' THEN r ELSE 30 END GROUP BY ALL""")
def o_sample_list(spark, sf):
    return C.sample_keys(problems(spark, sf))


@query("s_placeholders", _MESSAGES + "SELECT locale, key, array_to_string(vars, ',') AS vars, array_to_string(tags, ',') AS tags, CASE WHEN plural = '' THEN '' ELSE plural || ':plural' END AS plurals FROM facts")
def s_placeholders(spark, sf):
    value = F.col("value")
    sets = {"vars": L.variables(value), "tags": L.tags(value), "plurals": L.plurals(value)}
    return messages(spark, sf).select("locale", "key", *[F.array_join(F.array_sort(c), ",").alias(n) for n, c in sets.items()])


@query("s_allow_ident", _MESSAGES + "SELECT locale, key, neutral FROM facts")
def s_allow_ident(spark, sf):
    return messages(spark, sf).select("locale", "key", L.may_stay_identical(F.col("value")).alias("neutral"))


@query("s_json_flat", """SELECT event_id, unnest(['a.k', 'list[0]', 'list[1].b', 'list[1].c[0]', 'list[1].d', 'list[1].e', 'deep.a.b.c.d.e.f.g.h.i.j.k.l.m[0][1]', 'deep.n']) AS key,
  unnest([json_extract_string(props, '$.k'), user_id::VARCHAR, event_type, 'x', '{}', '[]', 'true', NULL]) AS value FROM events""")
def s_json_flat(spark, sf):
    """Items, members, empty containers, leaves that read like one, and twelve levels and more."""
    deep = "".join(f'{{"{c}":' for c in "abcdefghijklm") + "[[{},true]]" + "}" * 13
    doc = F.concat(F.lit('{"a":'), "props", F.lit(',"list":['), "user_id", F.lit(',{"b":"'), "event_type", F.lit(
        '","c":["x"],"d":"{}","e":"[]","f":{},"g":[]}],"deep":' + deep[:-1] + ',"n":null}}'))
    return C.flatten_json(source(spark, sf, "events").select("event_id", doc.alias("doc")), "doc")


@query("j_registry_diff", """WITH a AS (SELECT DISTINCT ps AS key FROM (SELECT l_suppkey * 3 AS ps FROM lineitem)), b AS (SELECT DISTINCT l_partkey AS key FROM lineitem)
  SELECT key, 'only_left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT key, 'only_right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def j_registry_diff(spark, sf):
    lines = source(spark, sf, "lineitem")
    return C.catalog_diff(lines.select((F.col("l_suppkey") * 3).alias("key")), lines.select(F.col("l_partkey").alias("key")))


@query("u_except", "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT l_suppkey * 3 FROM lineitem)")
def u_except(spark, sf):
    lines = source(spark, sf, "lineitem")
    return lines.select(F.col("l_partkey").alias("key")).subtract(lines.select((F.col("l_suppkey") * 3).alias("key")))


_SEGMENTS = ", ".join(f"('{s}')" for s in L.LOCALES)


@query("j_sitemap", f"""WITH paths AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) AS path FROM pages),
  entries AS (SELECT path, locale, 'https://site.example' || CASE WHEN locale = 'en' THEN path ELSE '/' || locale || path END AS url FROM paths, (VALUES {_SEGMENTS}) v(locale))
  SELECT path, locale, url, 11 AS alternates, 'https://site.example' || path AS x_default, 'https://site.example/zh-cn' || path AS zh FROM entries""")
def j_sitemap(spark, sf):
    path = F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1)
    site = C.sitemap(source(spark, sf, "pages").select(path.alias("path")).distinct(), "https://site.example")
    return site.select("path", "locale", "url", F.size("alternates").alias("alternates"),
                       F.col("alternates")["x-default"].alias("x_default"), F.col("alternates")["zh-CN"].alias("zh"))
