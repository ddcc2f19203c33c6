"""Logical tables derived from the given parquet tables.

The expressions below are plain SQL that Spark and the checking engine read
alike, so both sides start from identical rows; everything after that is
written twice, independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import TOOL_KEYS

AS_OF = "2024-01-31 00:00:00"

_START = "TIMESTAMP '2024-01-01 00:00:00'"
_USER_AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) AppleWebKit/605.1 Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (iPad; CPU OS 17_0) AppleWebKit/605.1 Version/17.0 Safari/604.1",
    "Mozilla/5.0 (X11; Linux) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Linux; Android 14; SM-S911B) SamsungBrowser/23.0 Chrome/115.0 Mobile Safari/537.36",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "Mozilla/5.0 (compatible; bingbot/2.0)",
    "AcmeCrawler-x/1.0",
    "",
    "Mozilla/5.0 (Windows NT 10.0) Chrome/119.0 Safari/537.36 OPR/105.0",
    "curl/8.4.0",
    "Mozilla/5.0 (compatible; GPTBot/1.1)",
    "Lynx/2.8.9",
    "Mozilla/5.0 (Linux; Android 13; SM-T500) Chrome/115.0 Safari/537.36",
    "Uptime-Check/2.0",
)
_REFERERS = (
    "https://www.google.com/search", "https://duckduckgo.com/", "https://netflix.com/a",
    "google.com/no-scheme", "http://User:pw@Blog.Example.ORG:8080/p",
    "http://my_host.example.com/x", "HTTPS://WWW.Reddit.COM/r/docs", "//www.www.example.net/y",
    "http://[2001:db8::5]:80/z", "", "mailto:someone@example.com", "https://t.co",
)
_PATHS = (
    "/", "/tools/merge", "/tools/split", "/about", "/fr/tools/merge", "/tools/redact",
    "/tools/retired_tool", "/en/", "/zh-cn", "/fr/privacy", "/de/about", "/ur/tools/ocr/",
    "/tools/ocr", "/fr/x/y/z", "/lawyers",
)


def _pick(by: str, values: tuple[str, ...], extra: str = "NULL") -> str:
    """CASE over ``by`` modulo the number of values; one more slot gives ``extra``."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {by} % {len(values) + 1} {arms} ELSE {extra} END"


def _listed(values: tuple[str, ...], index: str) -> str:
    return f"split_part('{','.join(values)}', ',', CAST({index} AS INT) + 1)"


# Options also come for documents that are not there: as many as every thirteenth, with identifiers below 0.
DOCUMENTS_AND_MISSING = """(SELECT * FROM documents
  UNION ALL SELECT * REPLACE (-1 - doc_id AS doc_id) FROM documents WHERE doc_id % 13 = 12) AS o"""

DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "requests": ("events", {
        "request_id": "event_id",
        "ts": "ts",
        "ip": ("CASE event_id % 13 "
               "WHEN 0 THEN concat('2001:db8:', user_id % 50, '::', event_id % 9) "
               "WHEN 1 THEN '::1' WHEN 2 THEN 'unknown' WHEN 3 THEN '' "
               "WHEN 4 THEN concat('::ffff:10.1.2.', event_id % 250) "
               "WHEN 5 THEN '1.2.3' WHEN 6 THEN NULL "
               "ELSE concat('10.', user_id % 64, '.', event_id % 200, '.', user_id % 250) END"),
        "user_agent": _pick("event_id", _USER_AGENTS),
        "referer": _pick("event_id", _REFERERS),
        "path": _pick("(event_id + user_id)", _PATHS, "concat('/tools/', event_type)"),
        "forwarded": ("CASE event_id % 5 WHEN 0 THEN concat(' 10.0.0.', event_id % 200, ' , 10.1.1.1') "
                      "WHEN 1 THEN '' WHEN 2 THEN NULL ELSE concat('192.168.', user_id % 200, '.7') END"),
        "edge_ip": ("CASE event_id % 4 WHEN 0 THEN concat('172.16.0.', user_id % 200) "
                    "WHEN 1 THEN '' ELSE NULL END"),
        "socket_host": "CASE event_id % 6 WHEN 0 THEN NULL ELSE concat('127.0.', user_id % 9, '.1') END",
        "tag": _pick("(event_id + 3 * user_id)",
                     ("en-US", "zh-TW", "zh-HK-x", "zh-CN", "zh", "fr-CA", "PT-br", "de-DE", "ar", "ur-PK", "")),
        "user_id": "user_id",
        "event_type": "event_type",
    }),
    "geo_blocks": ("supplier JOIN nation ON s_nationkey = n_nationkey", {
        "ip_start": "CAST(167772160 + s_suppkey * 32768 AS BIGINT)",
        "ip_end": "CAST(167772160 + s_suppkey * 32768 + 32767 - (s_suppkey % 3) * 1000 AS BIGINT)",
        "country": "CASE s_suppkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE n_name END",
        "city": "CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE s_name END",
    }),
    "jobs": ("orders", {
        "id": "CAST(o_orderkey AS STRING)",
        "tool": _listed(TOOL_KEYS, "o_custkey % 26"),
        "status": ("CASE WHEN o_orderstatus = 'F' THEN 'succeeded' "
                   "WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'queued' "
                   "WHEN o_orderstatus = 'O' THEN 'running' "
                   "WHEN o_orderkey % 5 = 0 THEN 'cancelled' ELSE 'failed' END"),
        "options": "concat('{\"level\":', o_orderkey % 3, '}')",
        "error": ("CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 4 = 0 THEN NULL "
                  "WHEN o_orderkey % 7 = 0 THEN '' "
                  "ELSE repeat(concat('failed: ', o_orderpriority, ' '), CAST(1 + o_orderkey % 40 AS INT)) END"),
        "created_at": f"{_START} + ((o_orderkey * 7919) % 2592000) * INTERVAL '1' SECOND",
        "output_bytes": "CAST(floor(o_totalprice * 150) AS BIGINT)",
    }),
    "files": ("documents", {
        "id": "CAST(doc_id AS STRING)",
        "content": "text",
        "filename": ("concat('doc', doc_id, CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' "
                     "WHEN 2 THEN '.png' WHEN 3 THEN '.JPG' WHEN 4 THEN '' WHEN 5 THEN '.docx' "
                     "ELSE '.webp' END)"),
        "mime": ("CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'IMAGE/PNG' "
                 "WHEN 2 THEN '' WHEN 3 THEN 'text/plain' ELSE 'image/jpeg' END"),
        "size_bytes": "CASE WHEN doc_id % 23 = 0 THEN 0 WHEN doc_id % 29 = 0 THEN 60000000 ELSE length(text) END",
        "head": "CASE doc_id % 3 WHEN 0 THEN 'garbage' ELSE '%PDF-1.7' END",
        "status": "CASE doc_id % 17 WHEN 0 THEN 'rejected' ELSE 'validated' END",
        "created_at": f"{_START} + (doc_id * 37) * INTERVAL '1' SECOND",
    }),
    "logins": ("events", {
        "id": "event_id",
        "username": "concat('user', user_id % 20)",
        "ip": "concat('10.9.', user_id % 3, '.1')",
        "success": "event_type = 'signup'",
        "created_at": f"{_START} + (event_id * 20) * INTERVAL '1' SECOND",
    }),
    "attempts": ("events", {
        "id": "event_id",
        "ts": "ts",
        "ip": "concat('10.7.0.', user_id % 2)",
        "tool": "CASE WHEN event_type IN ('view', 'click') THEN 'merge' ELSE 'split' END",
        "succeeded": "event_type <> 'error'",
    }),
    "job_events": ("events", {
        "seq": "event_id",
        "job_id": "user_id",
        "ts": "ts",
        "status": ("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' "
                   "WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"),
    }),
    "submissions": ("events", {
        "id": "event_id",
        "tool": "CASE user_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'split' ELSE 'ocr' END",
        "file_ids": "concat('[\"', user_id % 4, '\"]')",
        "options": "CASE user_id % 2 WHEN 0 THEN '{\"a\":1,\"b\":2}' ELSE '{\"b\":2,\"a\":1}' END",
        "status": ("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' "
                   "WHEN 'error' THEN 'failed' ELSE 'succeeded' END"),
        "created_at": f"{_START} + (event_id * 45) * INTERVAL '1' SECOND",
    }),
    "doc_pages": ("conversations", {
        "doc_id": "conv_id",
        "page_no": "CAST(turn + 1 AS INT)",
        "text": "text",
        "width_pt": "CAST(CASE conv_id % 2 WHEN 0 THEN 612 ELSE 595 END AS DOUBLE)",
        "height_pt": "CAST(CASE conv_id % 2 WHEN 0 THEN 792 ELSE 842 END AS DOUBLE)",
        "rotation": "CAST((turn % 4) * 90 AS INT)",
    }),
    "doc_options": (DOCUMENTS_AND_MISSING, {
        "doc_id": "doc_id",
        "lang": "lang",
        "spec": ("CASE doc_id % 11 WHEN 0 THEN '1-3,5' WHEN 1 THEN '2' WHEN 2 THEN ' 1 - 2 ' WHEN 3 THEN '5-3' "
                 "WHEN 4 THEN 'a' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '900' WHEN 8 THEN '1,1-2,2' "
                 "WHEN 9 THEN '0-2' ELSE '1-2,4-6,3' END"),
        "mode": "CASE doc_id % 7 WHEN 0 THEN 'every' WHEN 1 THEN 'odd' ELSE 'ranges' END",
        "angle": "CASE doc_id % 6 WHEN 0 THEN ' 90' WHEN 1 THEN '180' WHEN 2 THEN '45' WHEN 3 THEN '' ELSE '270' END",
        "rotations": ("CASE doc_id % 9 WHEN 0 THEN '{\"1\": 90}' WHEN 1 THEN '{\"1\": 270, \"2\": 180}' "
                      "WHEN 2 THEN '{\"1\": \"90\"}' WHEN 3 THEN '{}' WHEN 4 THEN '{\"x\": 90}' WHEN 5 THEN '{\"1\": 45}' "
                      "WHEN 6 THEN '{\"1\": 90, \" 1\": 180}' WHEN 7 THEN '{\"1\": 90, \"01\": 180}' ELSE '{\"1\": 90, \"1\": 180}' END"),
        "start_number": "CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '10' WHEN 2 THEN '2.5' WHEN 3 THEN '0' ELSE '100' END",
        "prefix": "CASE doc_id % 3 WHEN 0 THEN NULL ELSE 'p. ' END",
        "suffix": "CASE doc_id % 4 WHEN 0 THEN ' /' ELSE '' END",
        "out_id": "CAST(floor(CASE WHEN doc_id < 0 THEN -1 - doc_id ELSE doc_id END / 4) AS BIGINT)",
        "doc_seq": "CASE WHEN doc_id < 0 THEN 4 ELSE CAST(doc_id % 4 AS INT) END",
        "page_order": ("CASE CAST(floor(CASE WHEN doc_id < 0 THEN -1 - doc_id ELSE doc_id END / 4) AS BIGINT) % 5 WHEN 0 THEN '[[0,1],[1,1]]' WHEN 1 THEN '[[1,1],[0,1],[1,1]]' "
                       "WHEN 2 THEN '[[7,1]]' WHEN 3 THEN '[[0,1],[0,9999]]' ELSE 'nope' END"),
        "filename": "concat('doc', doc_id, '.pdf')",
        "patterns": ("CASE doc_id % 13 WHEN 0 THEN ' , ,' WHEN 1 THEN '' WHEN 2 THEN 'zq absent' WHEN 3 THEN 'e,th  of' "
                     "ELSE concat(split_part(text, ' ', 2), ', ', split_part(text, ' ', 6), ',zq absent') END"),
    }),
    "attributes": ("part", {
        "file_id": "p_partkey",
        "title": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('  ', chr(9), ' ') ELSE concat(' ', p_name, chr(10)) END",
        "author": "CASE p_partkey % 4 WHEN 0 THEN '' ELSE p_brand END",
        "subject": "CASE p_partkey % 3 WHEN 0 THEN NULL ELSE p_type END",
        "keywords": "CASE p_partkey % 5 WHEN 0 THEN NULL ELSE concat(p_name, ', ', p_type) END",
        "creator": "CASE p_partkey % 7 WHEN 0 THEN NULL ELSE concat('maker ', p_size) END",
        "producer": "CASE p_partkey % 8 WHEN 0 THEN NULL ELSE 'press 2' END",
        "creation_date": "CASE p_partkey % 9 WHEN 0 THEN NULL ELSE concat('D:2024', p_size) END",
        "modification_date": "CASE p_partkey % 10 WHEN 0 THEN NULL ELSE 'D:2025' END",
        "page_count": "CASE p_partkey % 12 WHEN 0 THEN 0 ELSE p_size END",
        "encrypted": "p_partkey % 19 = 0",
        "has_forms": "p_size > 25",
        "has_xmp": "p_partkey % 2 = 0",
    }),
}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = DERIVED[name]
    if base == DOCUMENTS_AND_MISSING:
        docs = source(spark, sf_dir, "documents")
        df = docs.unionByName(docs.filter("doc_id % 13 = 12").withColumn("doc_id", -1 - F.col("doc_id")))
    elif " JOIN " in base:
        left, rest = base.split(" JOIN ")
        right, on = rest.split(" ON ")
        df = source(spark, sf_dir, left).join(source(spark, sf_dir, right), F.expr(on))
    else:
        df = source(spark, sf_dir, base)
    out = df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    local = {f.name: F.col(f.name).cast("timestamp_ntz") for f in out.schema.fields
             if isinstance(f.dataType, T.TimestampType)}
    return out.withColumns(local) if local else out


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page rows: one page per line of text."""
    docs = source(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("page_no"), "text",
                        ((F.col("pos") + 1) % 4 * 90).alias("rotation"))


TEXT_PAGES = """SELECT doc_id, generate_subscripts(l, 1)::INT AS page_no, unnest(l) AS text, (generate_subscripts(l, 1) % 4 * 90)::INT AS rotation
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
COUNTS = "SELECT doc_id, count(*) AS page_count FROM pages_in GROUP BY 1"


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversation pages as recognised words with confidence and box."""
    pages = derived(spark, sf_dir, "doc_pages")
    words = pages.select("doc_id", "page_no", F.posexplode(F.split("text", " ")).alias("word_no", "text"))
    return words.selectExpr("*", *[f"{e} AS {c}" for c, e in _WORD.items()])


_WORD = {
    "conf": "CASE (doc_id + word_no) % 6 WHEN 0 THEN '95.5' WHEN 1 THEN '30' WHEN 2 THEN '29.99' WHEN 3 THEN '-1' WHEN 4 THEN 'n/a' ELSE '88' END",
    "left": "word_no % 40 * 30",
    "top": "CAST(floor(word_no / 40) AS INT) * 50",
    "width": "length(text) * 12",
    "height": "word_no % 5 * 10",
}
OCR_WORDS = "SELECT *, " + ", ".join(f'{e} AS "{c}"' for c, e in _WORD.items()) + """ FROM (SELECT doc_id, page_no,
  (generate_subscripts(string_split(text, ' '), 1) - 1)::INT AS word_no, unnest(string_split(text, ' ')) AS text FROM doc_pages)"""


def cte(*names: str, **more: str) -> str:
    """``WITH`` clause of derived tables, then of further named SELECTs."""
    parts = []
    for name in names:
        base, columns = DERIVED[name]
        body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {body} FROM {base})")
    parts += [f"{name} AS ({body})" for name, body in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
