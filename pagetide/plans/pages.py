"""Queries over document pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions import values as V
from ..operators import pages as P
from ..operators.skew import document_options, number_rows
from .inputs import COUNTS, TEXT_PAGES, cte, derived, source, text_pages
from .registry import query

_TOK = r"""SELECT doc_id, i, tok, regexp_matches(tok, '^\s*\d+\s*(-\s*\d+\s*)?$') AS ok, try_cast(regexp_extract(tok, '(\d+)', 1) AS BIGINT) AS s,
  coalesce(try_cast(nullif(regexp_extract(tok, '-\s*(\d+)', 1), '') AS BIGINT), try_cast(regexp_extract(tok, '(\d+)', 1) AS BIGINT)) AS e
  FROM (SELECT doc_id, unnest(string_split(spec, ',')) AS tok, generate_subscripts(string_split(spec, ','), 1) AS i FROM doc_options WHERE trim(coalesce(spec, '')) <> '')"""
_SPECS = """SELECT o.*, coalesce(c.page_count, 0) AS page_count, c.page_count IS NULL AS missing, trim(coalesce(o.spec, '')) = '' AS blank,
  (SELECT bool_or(NOT ok OR s < 1 OR e < s) FROM tok WHERE tok.doc_id = o.doc_id) AS malformed,
  (SELECT max(e) FROM tok WHERE tok.doc_id = o.doc_id) AS highest FROM doc_options o LEFT JOIN counts c ON c.doc_id = o.doc_id"""
_SEL = "SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS page_no FROM tok WHERE ok AND s >= 1 AND e >= s"
PAGES = cte("doc_options", pages_in=TEXT_PAGES, counts=COUNTS, tok=_TOK, specs=_SPECS, sel=_SEL)
_CODE = "CASE WHEN missing THEN 'missing_input' WHEN blank THEN {blank} WHEN malformed OR highest > page_count THEN '{code}' END"


def _pages(spark, sf):
    return text_pages(spark, sf), derived(spark, sf, "doc_options")


@query("s_ranges", PAGES + """, firsts AS (SELECT doc_id, arg_min(CASE WHEN NOT ok THEN 'invalid_page_range' WHEN s < 1 THEN 'invalid_range_start' WHEN e < s THEN 'reversed_range' END, i)
    FILTER (NOT ok OR s < 1 OR e < s) AS code FROM tok GROUP BY 1)
  SELECT o.doc_id, CASE WHEN blank OR malformed THEN 'invalid_option' END AS error_code,
  CASE WHEN NOT blank AND malformed THEN firsts.code WHEN blank THEN 'invalid_option' END AS client_code,
  (SELECT string_agg(page_no, ',' ORDER BY page_no) FROM (SELECT DISTINCT unnest(generate_series(s, e)) AS page_no FROM tok WHERE tok.doc_id = o.doc_id AND NOT o.malformed)) AS pages
  FROM specs o LEFT JOIN firsts ON firsts.doc_id = o.doc_id""")
def s_ranges(spark, sf):
    spec = F.col("spec")
    return derived(spark, sf, "doc_options").select(
        "doc_id", R.spec_code(spec).alias("error_code"), R.spec_code(spec, client_codes=True).alias("client_code"),
        F.array_join(R.page_list(spec), ",").alias("pages"))


@query("s_range_groups", PAGES + """SELECT doc_id, i - 1 AS group_no, s AS first, e AS last,
  CASE WHEN s = e THEN 'page-' || printf('%03d', s) ELSE printf('pages-%03d-%03d', s, e) END AS out_name
  FROM tok JOIN specs USING (doc_id) WHERE NOT malformed AND highest <= page_count""")
def s_range_groups(spark, sf):
    pages, options = _pages(spark, sf)
    per_doc = P.page_counts(pages).join(options, "doc_id")
    good = per_doc.filter(R.spec_code(F.col("spec"), F.col("page_count")).isNull())
    return good.select("doc_id", F.posexplode(R.intervals(F.col("spec"))).alias("group_no", "iv")).select(
        "doc_id", "group_no", F.col("iv.start").alias("first"), F.col("iv.end").alias("last"),
        V.split_name(F.col("iv.start"), F.col("iv.end")).alias("out_name"))


@query("f_page_select", PAGES + f"""SELECT s.doc_id, p.page_no, {_CODE.format(blank='NULL', code='invalid_option')} AS error_code, sha256(p.text) AS text
  FROM specs s LEFT JOIN pages_in p ON p.doc_id = s.doc_id AND (blank OR (NOT malformed AND highest <= page_count AND EXISTS (SELECT 1 FROM sel WHERE sel.doc_id = p.doc_id AND sel.page_no = p.page_no)))""")
def f_page_select(spark, sf):
    return P.select_pages(*_pages(spark, sf)).withColumn("text", F.sha2("text", 256))


_DEL = """, deletable AS (SELECT s.*, CASE WHEN missing THEN 'missing_input' WHEN blank THEN 'missing_option' WHEN malformed OR highest > page_count THEN 'bad_option'
    WHEN (SELECT count(*) FROM sel WHERE sel.doc_id = s.doc_id) >= page_count THEN 'bad_option' END AS error_code FROM specs s)
  SELECT d.doc_id, p.page_no AS old_page_no, row_number() OVER (PARTITION BY d.doc_id ORDER BY p.page_no) AS page_no, p.text, NULL AS error_code
  FROM deletable d JOIN pages_in p USING (doc_id) WHERE error_code IS NULL AND NOT EXISTS (SELECT 1 FROM sel WHERE sel.doc_id = p.doc_id AND sel.page_no = p.page_no)
  UNION ALL SELECT doc_id, NULL, NULL, NULL, error_code FROM deletable WHERE error_code IS NOT NULL"""


@query("j_delete_pages", PAGES + _DEL)
def j_delete_pages(spark, sf):
    return P.delete_pages(*_pages(spark, sf))


@query("w_renumber", PAGES + """SELECT doc_id, page_no AS old_page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no
  FROM pages_in WHERE text <> ''""")
def w_renumber(spark, sf):
    kept = text_pages(spark, sf).filter("text <> ''").select("doc_id", F.col("page_no").alias("old_page_no"))
    return number_rows(kept, ["doc_id"], "old_page_no", "page_no")


@query("w_page_label", PAGES + """, coded AS (SELECT *, CASE WHEN missing THEN 'missing_input' WHEN start_number IN ('2.5', '0') THEN 'invalid_option' WHEN blank THEN NULL
    WHEN malformed OR highest > page_count THEN 'invalid_option' END AS error_code FROM specs)
  SELECT c.doc_id, p.page_no, CASE WHEN chosen THEN coalesce(prefix, '') || (start_number::INT + row_number() OVER (PARTITION BY c.doc_id, chosen ORDER BY p.page_no) - 1) || suffix END AS label, NULL AS error_code
  FROM coded c JOIN (SELECT pages_in.*, sel.page_no IS NOT NULL OR trim(coalesce(spec, '')) = '' AS chosen FROM pages_in JOIN doc_options USING (doc_id)
    LEFT JOIN sel ON sel.doc_id = pages_in.doc_id AND sel.page_no = pages_in.page_no) p USING (doc_id) WHERE error_code IS NULL
  UNION ALL SELECT doc_id, NULL, NULL, error_code FROM coded WHERE error_code IS NOT NULL""")
def w_page_label(spark, sf):
    return P.label_pages(*_pages(spark, sf))


@query("j_rotate_sel", PAGES + """, coded AS (SELECT *, CASE WHEN missing THEN 'missing_input' WHEN angle = '' THEN 'missing_option' WHEN trim(angle) NOT IN ('90', '180', '270') THEN 'bad_option'
    WHEN blank THEN NULL WHEN malformed OR highest > page_count THEN 'bad_option' END AS error_code FROM specs)
  SELECT c.doc_id, p.page_no, CASE WHEN blank OR sel.page_no IS NOT NULL THEN (rotation + trim(angle)::INT) % 360 ELSE rotation END AS rotation, NULL AS error_code
  FROM coded c JOIN pages_in p USING (doc_id) LEFT JOIN sel ON sel.doc_id = p.doc_id AND sel.page_no = p.page_no WHERE error_code IS NULL
  UNION ALL SELECT doc_id, NULL, NULL, error_code FROM coded WHERE error_code IS NOT NULL""")
def j_rotate_sel(spark, sf):
    return P.rotate_pages(*_pages(spark, sf))


@query("j_rotation_map", PAGES + """, coded AS (SELECT *, CASE WHEN missing THEN 'missing_input' WHEN doc_id % 9 BETWEEN 2 AND 5 OR (doc_id % 9 = 1 AND page_count < 2) THEN 'bad_option' END AS error_code FROM specs)
  SELECT c.doc_id, p.page_no, (rotation + CASE WHEN p.page_no = 1 THEN CASE c.doc_id % 9 WHEN 0 THEN 90 WHEN 1 THEN 270 ELSE 180 END WHEN p.page_no = 2 AND c.doc_id % 9 = 1 THEN 180 ELSE 0 END) % 360 AS rotation, NULL AS error_code
  FROM coded c JOIN pages_in p USING (doc_id) WHERE error_code IS NULL
  UNION ALL SELECT doc_id, NULL, NULL, error_code FROM coded WHERE error_code IS NOT NULL""")
def j_rotation_map(spark, sf):
    return P.rotate_by_map(*_pages(spark, sf))


_ORDERS = """orders_in AS (SELECT doc_id, page_count, missing, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN array_to_string(list_reverse(range(1, page_count + 1)), ', ')
    WHEN 2 THEN array_to_string(list_concat(range(2, page_count + 1), [1]), ',') WHEN 3 THEN '1,1' ELSE '1,x' END AS "order" FROM specs)"""


def _orders(spark, sf):
    n = F.greatest(F.col("page_count"), F.lit(1)).cast("int")
    up = F.sequence(F.lit(1), n)
    shifted = F.concat(F.slice(up, F.lit(2), n), F.array(F.lit(1)))
    order = (F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.array_join(F.reverse(up), ", "))
             .when(F.col("doc_id") % 5 == 2, F.array_join(shifted, ",")).when(F.col("doc_id") % 5 == 3, "1,1").otherwise("1,x"))
    return document_options(*_pages(spark, sf)).select("doc_id", order.alias("order"))


@query("j_reorder", PAGES + f""", {_ORDERS}
  SELECT p.doc_id, p.page_no AS old_page_no, CASE doc_id % 5 WHEN 1 THEN page_count + 1 - page_no WHEN 2 THEN CASE page_no WHEN 1 THEN page_count ELSE page_no - 1 END END AS page_no, text, NULL AS error_code
  FROM pages_in p JOIN counts USING (doc_id) WHERE doc_id % 5 IN (1, 2)
  UNION ALL SELECT doc_id, NULL, NULL, NULL, CASE WHEN missing THEN 'missing_input' WHEN doc_id % 5 = 0 THEN 'missing_option' ELSE 'bad_option' END FROM orders_in WHERE missing OR doc_id % 5 IN (0, 3, 4)""")
def j_reorder(spark, sf):
    return P.reorder_pages(text_pages(spark, sf), _orders(spark, sf))


@query("s_perm", PAGES + f""", {_ORDERS} SELECT doc_id, coalesce(list_sort(try_cast(string_split(replace("order", ' ', ''), ',') AS BIGINT[])) = range(1, page_count + 1), false) AS is_permutation FROM orders_in WHERE NOT missing""")
def s_perm(spark, sf):
    orders = _orders(spark, sf).join(P.page_counts(text_pages(spark, sf)), "doc_id")
    return orders.select("doc_id", P.is_permutation(P.parse_order(F.col("order")), F.col("page_count")).alias("is_permutation"))


_SPLIT = PAGES + """, coded AS (SELECT *, CASE WHEN missing THEN 'missing_input' WHEN mode = 'odd' THEN 'bad_option' WHEN mode = 'every' THEN NULL WHEN blank THEN 'missing_option'
    WHEN malformed OR highest > page_count THEN 'bad_option' END AS error_code FROM specs),
  parts AS (SELECT c.doc_id, i - 1 AS group_no, CASE WHEN s = e THEN printf('page-%03d', s) ELSE printf('pages-%03d-%03d', s, e) END AS out_name, p.page_no
    FROM coded c JOIN tok USING (doc_id) JOIN pages_in p ON p.doc_id = c.doc_id AND p.page_no BETWEEN s AND e WHERE error_code IS NULL AND mode = 'ranges'
    UNION ALL SELECT c.doc_id, page_no - 1, printf('page-%03d', page_no), page_no FROM coded c JOIN pages_in USING (doc_id) WHERE mode = 'every')
"""


@query("j_split", _SPLIT + "SELECT *, NULL AS error_code FROM parts UNION ALL SELECT doc_id, NULL, NULL, NULL, error_code FROM coded WHERE error_code IS NOT NULL")
def j_split(spark, sf):
    return P.split_pages(*_pages(spark, sf))


@query("snk_groups", _SPLIT + "SELECT doc_id, group_no, out_name, count(*) AS pages FROM parts GROUP BY ALL")
def snk_groups(spark, sf):
    return P.split_outputs(P.split_pages(*_pages(spark, sf)))


_MERGED = """in_order AS (SELECT out_id, row_number() OVER (PARTITION BY out_id ORDER BY doc_seq, page_no) AS out_page_no, doc_seq, doc_id, page_no, text
  FROM doc_options JOIN pages_in USING (doc_id))"""


@query("u_merge", PAGES + f", {_MERGED} SELECT *, NULL AS error_code FROM in_order UNION ALL SELECT out_id, NULL, NULL, doc_id, NULL, NULL, 'missing_input' FROM specs WHERE missing")
def u_merge(spark, sf):
    pages, options = _pages(spark, sf)
    return P.merge_documents(pages, options.select("out_id", "doc_id", "doc_seq"))


@query("j_merge_order", PAGES + """, jobs_in AS (SELECT DISTINCT out_id, page_order FROM doc_options), members AS (SELECT out_id, doc_seq, doc_id, page_count FROM specs WHERE NOT missing),
  refs AS (SELECT out_id, unnest([0, 1]) AS doc_seq, 1 AS page_no, unnest([1, 2]) AS out_page_no FROM jobs_in WHERE out_id % 5 = 0
    UNION ALL SELECT out_id, unnest([1, 0, 1]), 1, unnest([1, 2, 3]) FROM jobs_in WHERE out_id % 5 = 1),
  bad AS (SELECT out_id FROM jobs_in WHERE out_id % 5 > 1 UNION SELECT r.out_id FROM refs r LEFT JOIN members m USING (out_id, doc_seq) WHERE m.doc_id IS NULL)
  SELECT out_id, out_page_no, doc_seq, page_no, text, NULL AS error_code FROM refs JOIN members USING (out_id, doc_seq) JOIN pages_in USING (doc_id, page_no) WHERE out_id NOT IN (SELECT out_id FROM bad)
  UNION ALL SELECT out_id, NULL, NULL, NULL, NULL, 'bad_option' FROM bad""")
def j_merge_order(spark, sf):
    pages, options = _pages(spark, sf)
    return P.merge_by_order(pages, options.select("out_id", "doc_id", "doc_seq"),
                            options.select("out_id", "page_order").distinct())


@query("j_is_identity", PAGES + f", {_MERGED}, sized AS (SELECT out_id, count(*) AS n FROM in_order GROUP BY 1) SELECT out_id, out_id % 3 = 0 OR (out_id % 3 = 2 AND n = 1) AS is_identity FROM sized")
def j_is_identity(spark, sf):
    """References in natural order, without the last page, or backwards."""
    pages, options = _pages(spark, sf)
    natural = P.merge_documents(pages, options.select("out_id", "doc_id", "doc_seq")).filter("error_code IS NULL").select(
        "out_id", F.col("out_page_no").alias("pos"), "doc_seq", "page_no")
    sizes = natural.groupBy("out_id").agg(F.max("pos").alias("n"))
    kind = F.col("out_id") % 3
    refs = natural.join(sizes, "out_id").filter((kind != 1) | (F.col("pos") < F.col("n"))).withColumn(
        "pos", F.when(kind == 2, F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos")))
    return P.is_natural_order(refs, natural)


def _letters(n: str) -> str:
    """Check SQL for A, B, .. Z, AA, ..: one arm for each number of letters."""
    arms, start = [], 0
    for length in range(1, 7):
        digits = " || ".join(f"chr((65 + ({n} - {start}) // {26 ** k} % 26)::INT)" for k in reversed(range(length)))
        start += 26 ** length
        arms.append(f"WHEN {n} < {start} THEN {digits}")
    return f"CASE {' '.join(arms)} END"


_EXHIBITS = """, docs AS (SELECT lang AS out_id, o.doc_id, filename, coalesce(page_count, 0) AS page_count, row_number() OVER (PARTITION BY lang ORDER BY o.doc_id) - 1 AS place FROM doc_options o LEFT JOIN counts ON counts.doc_id = o.doc_id),
  stamped AS (SELECT out_id, doc_id, page_no, place, 'BATES-' || printf('%06d', 999000 + row_number() OVER (PARTITION BY out_id ORDER BY doc_id, page_no) - 1) AS stamp FROM docs JOIN pages_in USING (doc_id)),
  slips AS (SELECT out_id, doc_id, 0 AS page_no, place, 'Exhibit ' || """ + _letters("place") + """ || ' | ' || filename || ' | ' || page_count || ' page(s)' AS stamp FROM docs)
"""
_NO_PAGES = " UNION ALL SELECT out_id, NULL, doc_id, NULL, NULL, 'missing_input' FROM docs WHERE page_count = 0"


def _exhibits(spark, sf, slips):
    pages, options = _pages(spark, sf)
    members = options.select(F.col("lang").alias("out_id"), "doc_id", F.col("doc_id").alias("doc_seq"), "filename")
    return P.combine_exhibits(pages, members, bates_start=999000, slip_sheets=slips)


@query("w_bates", PAGES + _EXHIBITS + "SELECT out_id, row_number() OVER (PARTITION BY out_id ORDER BY doc_id, page_no) AS sheet_no, doc_id, page_no, stamp, NULL AS error_code FROM stamped" + _NO_PAGES)
def w_bates(spark, sf):
    return _exhibits(spark, sf, False)


@query("w_slip_sheet", PAGES + _EXHIBITS + """SELECT out_id, row_number() OVER (PARTITION BY out_id ORDER BY doc_id, page_no) AS sheet_no, doc_id, page_no, stamp, NULL AS error_code
  FROM (SELECT * FROM stamped UNION ALL SELECT * FROM slips)""" + _NO_PAGES)
def w_slip_sheet(spark, sf):
    return _exhibits(spark, sf, True)


@query("w_nup", PAGES + """SELECT doc_id, page_no, (r // 6) + 1 AS sheet_no, (r % 6) % 3 AS col, (r % 6) // 3 AS row
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS r FROM pages_in)""")
def w_nup(spark, sf):
    return P.n_up(text_pages(spark, sf), 6, landscape=True)


_RUNS = """SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM
  (SELECT doc_id, min(page_no) AS a, max(page_no) AS b FROM (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g
   FROM (SELECT DISTINCT doc_id, page_no FROM {}) q) GROUP BY doc_id, g) GROUP BY doc_id"""


@query("w_ranges_out", PAGES + _RUNS.format("(SELECT * FROM pages_in WHERE length(text) % 3 > 0)"))
def w_ranges_out(spark, sf):
    return P.compact_ranges(text_pages(spark, sf).filter(F.length("text") % 3 > 0))


@query("u_distinct_pages", _RUNS.format("(SELECT l_orderkey AS doc_id, l_linenumber AS page_no FROM lineitem)"))
def u_distinct_pages(spark, sf):
    return P.compact_ranges(source(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")))


@query("w_dividers", PAGES + """SELECT doc_id, group_no, min(page_no) AS first, max(page_no) AS last FROM (SELECT p.doc_id, p.page_no,
  sum(CASE WHEN p.page_no - 1 IN (3, doc_id % 9) AND p.page_no > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.page_no) AS group_no FROM pages_in p) GROUP BY 1, 2""")
def w_dividers(spark, sf):
    pages, options = _pages(spark, sf)
    n = (F.col("doc_id") % 9).cast("int")
    dividers = options.select("doc_id", F.array(F.lit(3), n, F.lit(-4), F.lit(3), F.lit(100000)).alias("dividers"))
    return P.divider_groups(P.group_by_dividers(pages, dividers))


@query("u_append_new", PAGES + """SELECT doc_id, page_no, CASE WHEN length(text) % 2 = 0 THEN 'kept' ELSE 'appended' END AS origin FROM pages_in""")
def u_append_new(spark, sf):
    pages = text_pages(spark, sf)
    have = pages.filter(F.length("text") % 2 == 0).select("doc_id", "page_no", F.lit("kept").alias("origin"))
    offered = pages.select("doc_id", "page_no", F.lit("appended").alias("origin"))
    return P.append_new(have, offered, ["doc_id", "page_no"])


_PAIRS = """l AS (SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no, text FROM conversations),
  r AS (SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no, CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN text || '.' ELSE text END AS text
    FROM conversations WHERE NOT (role = 'system' AND conv_id % 2 = 0)),
  cmp AS (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, coalesce(l.page_no, r.page_no) AS page_no,
    CASE WHEN l.pair_id IS NULL THEN 'added' WHEN r.pair_id IS NULL THEN 'removed' WHEN l.text IS NOT DISTINCT FROM r.text THEN 'unchanged' ELSE 'changed' END AS state
    FROM l FULL JOIN r ON l.pair_id = r.pair_id AND l.page_no = r.page_no)"""


def _pairs(spark, sf):
    turns = source(spark, sf, "conversations").withColumnRenamed("conv_id", "pair_id")
    # turns are dense from 0; the revised side loses some and is renumbered
    left = turns.select("pair_id", (F.col("turn") + 1).alias("page_no"), "text")
    changed = F.when((F.col("role") == "assistant") & (F.col("pair_id") % 3 == 0), F.concat("text", F.lit("."))).otherwise(F.col("text"))
    kept = turns.filter(~((F.col("role") == "system") & (F.col("pair_id") % 2 == 0)))
    numbered = number_rows(kept.select("pair_id", F.col("turn").alias("_t"), changed.alias("text")), ["pair_id"], "_t", "page_no")
    return left, numbered.select("pair_id", "page_no", "text")


@query("j_compare_pages", f"WITH {_PAIRS} SELECT * FROM cmp")
def j_compare_pages(spark, sf):
    return P.compare_documents(*_pairs(spark, sf))


@query("a_compare_summary", f"""WITH {_PAIRS} SELECT pair_id, count(*) AS pages, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'changed') AS changed,
  count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'removed') AS removed, CASE WHEN bool_and(state = 'unchanged') THEN 'no_differences' END AS error_code FROM cmp GROUP BY 1""")
def a_compare_summary(spark, sf):
    return P.comparison_summary(P.compare_documents(*_pairs(spark, sf)))


@query("s_exhibit", f"SELECT doc_id, {_letters('doc_id')} AS letters FROM documents")
def s_exhibit(spark, sf):
    return source(spark, sf, "documents").select("doc_id", V.exhibit_letter(F.col("doc_id")).alias("letters"))


@query("s_bates", "SELECT doc_id, 'BATES-' || CASE WHEN n < 1000000 THEN right('000000' || n, 6) ELSE n::VARCHAR END AS stamp FROM (SELECT doc_id, doc_id * 7001 AS n FROM documents)")
def s_bates(spark, sf):
    return source(spark, sf, "documents").select("doc_id", V.bates_label("BATES", F.col("doc_id") * 7001).alias("stamp"))


@query("s_label_check", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR NOT regexp_full_match(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END, '[A-Za-z0-9 _-]+') THEN 'invalid_option' END AS code FROM part""")
def s_label_check(spark, sf):
    label = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    return source(spark, sf, "part").select("p_partkey", V.label_code(label).alias("code"))


_RAW_INT = "CASE p_partkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN '2.5' WHEN 2 THEN '12.0' WHEN 3 THEN 'x' WHEN 4 THEN NULL ELSE CAST(p_size AS STRING) END"


@query("s_int_opt", f"""SELECT p_partkey, CASE WHEN ok THEN v::INT END AS value, CASE WHEN NOT ok THEN 'invalid_option' END AS code FROM
  (SELECT p_partkey, v, coalesce(v = floor(v) AND v BETWEEN 6 AND 48, false) AS ok FROM (SELECT p_partkey, try_cast({_RAW_INT} AS DOUBLE) AS v FROM part))""")
def s_int_opt(spark, sf):
    value, code = V.int_option(F.expr(_RAW_INT), 6, 48)
    return source(spark, sf, "part").select("p_partkey", value.alias("value"), code.alias("code"))


@query("s_rotate", "SELECT p_partkey, ((a % 360) + 360) % 360 AS angle, ((a % 360) + 360) % 360 IN (90, 180, 270) AS is_turn FROM (SELECT p_partkey, (p_size - 25) * 45 AS a FROM part)")
def s_rotate(spark, sf):
    angle = V.normal_angle((F.col("p_size") - 25) * 45)
    return source(spark, sf, "part").select("p_partkey", angle.alias("angle"), V.is_quarter_turn(angle).alias("is_turn"))
