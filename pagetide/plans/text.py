"""Queries over the text of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import text as X
from ..session import checkpoint_root
from .inputs import OCR_WORDS, cte, derived, ocr_words, source, text_pages
from .pages import PAGES
from .registry import query

_STRIP = r"regexp_replace({}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"

_TEXTS = PAGES + """, extracted AS (SELECT s.doc_id, CASE WHEN missing THEN 'missing_input' WHEN blank THEN NULL WHEN malformed OR highest > page_count THEN 'invalid_option' END AS error_code,
    """ + _STRIP.format("""(SELECT string_agg(regexp_replace(text, '\\n+$', ''), chr(10) || chr(10) ORDER BY page_no) FROM pages_in p WHERE p.doc_id = s.doc_id
      AND (blank OR EXISTS (SELECT 1 FROM sel WHERE sel.doc_id = p.doc_id AND sel.page_no = p.page_no)))""") + """ || chr(10) AS text FROM specs s)
"""


@query("t_extract", _TEXTS + "SELECT doc_id, CASE WHEN error_code IS NULL THEN text END AS text, error_code FROM extracted")
def t_extract(spark, sf):
    return X.extract_text(text_pages(spark, sf), derived(spark, sf, "doc_options").select("doc_id", "spec"))


@query("snk_text", _TEXTS + "SELECT doc_id, sha256(text) AS sha256 FROM extracted WHERE error_code IS NULL")
def snk_text(spark, sf):
    path = f"{checkpoint_root(spark)}/texts-{uuid.uuid4().hex}"
    X.write_texts(t_extract(spark, sf), path)
    return spark.read.parquet(path).select("doc_id", F.sha2("text", 256).alias("sha256"))


_REDACT = PAGES + """, lits AS (SELECT doc_id, patterns, list_distinct(list_filter(list_transform(string_split(patterns, ','), lambda p: """ + _STRIP.format("p") + """), lambda p: p <> '')) AS lits FROM doc_options),
  hit AS (SELECT p.doc_id, page_no, text, lits, patterns, list_sort(list_filter(lits, lambda l: contains(text, l))) AS found FROM pages_in p JOIN lits USING (doc_id)),
  done AS (SELECT *, CASE WHEN len(found) = 0 THEN text ELSE list_reduce(list_prepend(text, found), lambda acc, l: replace(acc, l, repeat(' ', length(l)))) END AS redacted,
    coalesce(list_sum(list_transform(found, lambda l: (length(text) - length(replace(text, l, ''))) // length(l))), 0) AS matches FROM hit),
  verdict AS (SELECT o.doc_id, count(d.page_no) AS pages, coalesce(sum(d.matches), 0) AS matches, CASE WHEN count(d.page_no) = 0 THEN 'missing_input' WHEN trim(any_value(o.patterns)) = '' THEN 'missing_option'
    WHEN len(any_value(o.lits)) = 0 THEN 'invalid_option' WHEN sum(d.matches) = 0 THEN 'no_matches'
    WHEN bool_or(len(list_filter(d.lits, lambda l: contains(redacted, l))) > 0) THEN 'redaction_failed' END AS error_code FROM lits o LEFT JOIN done d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
"""


def _patterns(spark, sf):
    return derived(spark, sf, "doc_options").select("doc_id", "patterns")


@query("s_redact_list", _REDACT + "SELECT doc_id, array_to_string(list_sort(lits), '|') AS literals, CASE WHEN len(lits) = 0 THEN 'invalid_option' END AS error_code FROM lits")
def s_redact_list(spark, sf):
    literals = F.array_sort(F.array_distinct(V.literal_list(F.col("patterns"))))
    return _patterns(spark, sf).select("doc_id", F.array_join(literals, "|").alias("literals"),
                                       F.when(F.size(literals) == 0, "invalid_option").alias("error_code"))


@query("t_redact", _REDACT + """SELECT doc_id, page_no, redacted AS text, matches, NULL AS error_code FROM done WHERE doc_id IN (SELECT doc_id FROM verdict WHERE error_code IS NULL)
  UNION ALL SELECT doc_id, NULL, NULL, NULL, error_code FROM verdict WHERE error_code IS NOT NULL""")
def t_redact(spark, sf):
    return X.redact_documents(text_pages(spark, sf), _patterns(spark, sf))


@query("t_redact_verify", _REDACT + "SELECT doc_id, pages, matches, error_code FROM verdict")
def t_redact_verify(spark, sf):
    return X.redaction_verdicts(text_pages(spark, sf), _patterns(spark, sf))


@query("t_needs_ocr", PAGES + "SELECT doc_id, count(*) AS total, sum(scan) AS ocr_pages, count(*) - sum(scan) AS skipped FROM (SELECT doc_id, CASE WHEN length("
       + _STRIP.format("text") + ") < 50 THEN 1 ELSE 0 END AS scan FROM pages_in) GROUP BY 1")
def t_needs_ocr(spark, sf):
    return X.ocr_plan(text_pages(spark, sf))


_WORDS = cte("doc_pages", words=OCR_WORDS, kept="SELECT doc_id, page_no, word_no, " + _STRIP.format("text") + """ AS text FROM words
  WHERE """ + _STRIP.format("text") + " <> '' AND try_cast(conf AS DOUBLE) >= 30 AND width > 0 AND height > 0")


@query("f_word_conf", _WORDS + "SELECT * FROM kept")
def f_word_conf(spark, sf):
    return X.usable_words(ocr_words(spark, sf)).select("doc_id", "page_no", "word_no", "text")


@query("j_interleave", _WORDS + """SELECT p.doc_id, p.page_no, length(""" + _STRIP.format("p.text") + """) < 50 AS from_ocr, CASE WHEN length(""" + _STRIP.format("p.text") + """) < 50
  THEN coalesce((SELECT string_agg(k.text, ' ' ORDER BY word_no) FROM kept k WHERE k.doc_id = p.doc_id AND k.page_no = p.page_no), '') ELSE p.text END AS text FROM doc_pages p""")
def j_interleave(spark, sf):
    return X.interleave(derived(spark, sf, "doc_pages"), ocr_words(spark, sf))


@query("s_ocr_geom", _WORDS + """SELECT w.doc_id, w.page_no, word_no, round("left" * 0.36, 3) AS x_pt, round(p.height_pt - (top + height) * 0.36, 3) AS y_pt,
  round(greatest(height * 0.36, 1), 3) AS font_pt FROM words w JOIN doc_pages p USING (doc_id, page_no)""")
def s_ocr_geom(spark, sf):
    heights = derived(spark, sf, "doc_pages").select("doc_id", "page_no", "height_pt")
    words = ocr_words(spark, sf).join(heights, ["doc_id", "page_no"])
    box = V.ocr_box(*[F.col(c) for c in ("left", "top", "width", "height", "height_pt")])
    return words.select("doc_id", "page_no", "word_no", *[F.round(c, 3).alias(n) for n, c in box.items()])


_DAMAGED = "SELECT conv_id AS doc_id, turn, role <> 'system' AND conv_id % 7 <> 0 AS readable, conv_id % 10 = 0 AS encrypted FROM conversations"


def damaged_pages(spark, sf):
    return source(spark, sf, "conversations").selectExpr(
        "conv_id AS doc_id", "turn AS page_no", "role <> 'system' AND conv_id % 7 <> 0 AS readable", "conv_id % 10 = 0 AS encrypted")


@query("t_repair_triage", f"""SELECT doc_id, sum(readable::INT) AS kept, sum((NOT readable)::INT) AS dropped, CASE WHEN bool_or(encrypted) THEN 'encrypted_pdf'
  WHEN sum(readable::INT) = 0 THEN 'unrepairable' END AS error_code FROM ({_DAMAGED}) GROUP BY 1""")
def t_repair_triage(spark, sf):
    return X.triage(damaged_pages(spark, sf))


@query("t_salvage", f"SELECT doc_id, turn AS page_no FROM ({_DAMAGED}) WHERE readable AND NOT encrypted")
def t_salvage(spark, sf):
    return X.salvage(damaged_pages(spark, sf)).select("doc_id", "page_no")
