"""Queries over placed characters, lines and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.glyphs import OTHER, OTHER_LOWER, OTHER_UPPER, WIDTHS
from ..operators import layout as Y
from .inputs import TEXT_PAGES, cte, derived, text_pages
from .registry import query

# Geometry of a character: line number l and place p within the line, both from 0.
_GLYPH = {
    "size": "CAST(CASE WHEN l = 0 THEN 18 ELSE 12 END AS DOUBLE)",
    "x0": "CAST(50 + p * CASE WHEN l = 0 THEN 9 ELSE 6 END + CASE WHEN p % 11 > 6 THEN 1 ELSE 0 END AS DOUBLE)",
    "y0": "CAST(780 - l * 14 - floor(l / 4) * 16 - CASE WHEN ch IN ('.', ',') THEN 1 WHEN ch = '-' THEN -7 ELSE 0 END AS DOUBLE)",
    "wide": "CAST(CASE WHEN ch = ' ' THEN 3 ELSE 5 END AS DOUBLE)",
    "tall": "CAST(CASE WHEN ch = ' ' THEN 0 WHEN ch IN ('.', ',', '-') THEN 2 WHEN l = 0 THEN 13 ELSE 9 END AS DOUBLE)",
    "bold": "l = 0 OR p % 50 < 10",
}


def page_chars(spark, sf):
    """Characters of the conversation pages; some spaces are left out, so that they
    have to be found again from the gaps."""
    lines = derived(spark, sf, "doc_pages").select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    lines = Y.by_page(lines)
    singles = F.transform(F.sequence(F.lit(1), F.length("line")), lambda i: F.substring(F.col("line"), i, F.lit(1)))
    chars = lines.filter("line <> ''").select("doc_id", "page_no", "l", F.posexplode(singles).alias("p", "ch"))
    shaped = chars.filter("NOT (ch = ' ' AND p % 3 = 0)").selectExpr("*", *[f"{e} AS {c}" for c, e in _GLYPH.items()])
    return shaped.select("doc_id", "page_no", "l", "p", "ch", "x0", "y0", (F.col("x0") + F.col("wide")).alias("x1"),
                         (F.col("y0") + F.col("tall")).alias("y1"), "size", "bold")


_CHARS = cte("doc_pages", lines_in="""SELECT doc_id, page_no, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l, unnest(string_split(text, chr(10))) AS line FROM doc_pages""",
             raw="""SELECT doc_id, page_no, l, generate_series - 1 AS p, substr(line, generate_series, 1) AS ch FROM lines_in, generate_series(1, length(line))""",
             chars="SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _GLYPH.items()) + " FROM raw WHERE NOT (ch = ' ' AND p % 3 = 0)")
_TABLE = (f"CASE WHEN ascii(ch) BETWEEN 32 AND 126 THEN ({list(WIDTHS)}::DOUBLE[])[ascii(ch) - 31] "
          f"WHEN regexp_matches(ch, '\\p{{Lu}}') THEN {OTHER_UPPER} WHEN regexp_matches(ch, '\\p{{Ll}}') THEN {OTHER_LOWER} ELSE {OTHER} END")


_STEPS = f""", steps AS (SELECT *, {_TABLE}::DOUBLE AS t FROM (SELECT *, (lead(x0) OVER (PARTITION BY doc_id, page_no, l ORDER BY x0, p) - x0) / size AS d FROM chars) WHERE d > 0 AND ch <> ' '),
  adv AS (SELECT doc_id, page_no, ch, least(t, coalesce(CASE WHEN len(ds) >= 2 THEN ds[least(1, len(ds) // 4) + 1] ELSE ds[1] END, t)) AS advance
    FROM (SELECT doc_id, page_no, ch, any_value(t) AS t, list_sort(list(d) FILTER (d >= 0.5 * t)) AS ds FROM steps GROUP BY ALL))
"""


@query("a_advance_est", _CHARS + _STEPS + "SELECT doc_id, page_no, ch, round(advance, 6) AS advance FROM adv")
def a_advance_est(spark, sf):
    lined = page_chars(spark, sf).withColumnsRenamed({"l": "line_no", "p": "pos"})
    return Y.estimate_advances(lined).withColumn("advance", F.round("advance", 6))


# Marks too low or too high for the tolerance stand in lines of their own until they are given back.
_MARKS = "CASE WHEN ch IN (' ', '.', ',') THEN 0 WHEN ch = '-' AND l > 0 THEN 1 ELSE 2 END"


@query("t_lines", _CHARS + f"SELECT doc_id, page_no, count(DISTINCT l * 3 + {_MARKS}) AS lines, count(*) AS chars FROM chars GROUP BY ALL")
def t_lines(spark, sf):
    lined = Y.assign_lines(page_chars(spark, sf).drop("l", "p"), reattach=False)
    return lined.groupBy("doc_id", "page_no").agg(F.max("line_no").alias("lines"), F.count("*").alias("chars"))


# A small mark goes to the gap between two full-size characters that it stands in: of its own line, else (where
# normal characters are tall enough to reach it) of the next line for low marks and of the line before for high
# ones. A gap takes one mark, the first from the top.
_HOME = f""", normal AS (SELECT doc_id, page_no, list_sort(list(tall) FILTER (ch <> ' '))[count(*) FILTER (ch <> ' ') // 2 + 1] AS n FROM chars GROUP BY ALL),
  apart AS (SELECT *, {_MARKS} AS c, coalesce(ch <> ' ' AND tall < 0.45 * n, false) AS tiny FROM chars JOIN normal USING (doc_id, page_no)),
  slots AS (SELECT * FROM (SELECT doc_id, page_no, l AS gl, p AS gp, x0 + wide AS lo, lead(x0) OVER w AS hi, n, tiny OR lead(tiny) OVER w AS small
    FROM apart WHERE c = 2 WINDOW w AS (PARTITION BY doc_id, page_no, l ORDER BY p)) WHERE hi - lo < 2 * n AND NOT small),
  reach AS (SELECT *, CASE WHEN c = 0 AND (l + 1) % 4 <> 0 AND n >= 9.5 THEN l + 1 WHEN c = 1 AND l % 4 <> 0 AND n >= CASE WHEN l = 1 THEN 12.5 ELSE 10.5 END THEN l - 1 END AS far
    FROM apart WHERE tiny AND c < 2),
  tried AS (SELECT r.doc_id, r.page_no, r.l, r.p, gl, gp, row_number() OVER (PARTITION BY r.doc_id, r.page_no, r.l, r.p ORDER BY abs(gl - r.l)) AS choice,
      CASE WHEN gl = r.l THEN 2 - r.c ELSE 3 * r.c END AS turn
    FROM reach r JOIN slots g ON g.doc_id = r.doc_id AND g.page_no = r.page_no AND (gl = r.l OR gl = far) AND r.x0 BETWEEN lo AND hi),
  taken AS (SELECT doc_id, page_no, l, p, gl FROM (SELECT * FROM tried WHERE choice = 1) QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, gl, gp ORDER BY turn, p) = 1),
  home AS (SELECT a.*, coalesce(gl, l) * 3 + CASE WHEN gl IS NOT NULL OR c = 2 THEN 1 WHEN c = 1 THEN 0 ELSE 2 END AS k FROM apart a LEFT JOIN taken USING (doc_id, page_no, l, p))
"""


# The same rule mark by mark, as blocks need it. A page's marks are visited line by line from the top, left to right,
# those that were given away again in their new line. A mark that stands in no free gap of its line goes to the nearest
# line, at most a normal height from its present mean, with a free gap around its left edge, edges included. Between
# equal left edges the newcomer stands last, so a gap is free if no other mark starts from the left edge of its first
# character up to, but not at, that of its second.
_HOME_BY_VISIT = f""", normal AS (SELECT doc_id, page_no, list_sort(list(tall) FILTER (ch <> ' '))[count(*) FILTER (ch <> ' ') // 2 + 1] AS n FROM chars GROUP BY ALL),
  apart AS (SELECT *, {_MARKS} AS c, y0 + tall / 2 AS mid, coalesce(ch <> ' ' AND tall < 0.45 * n, false) AS tiny FROM chars JOIN normal USING (doc_id, page_no)),
  slots AS (SELECT * FROM (SELECT doc_id, page_no, l AS g, x0 AS a, x0 + wide AS lo, lead(x0) OVER w AS hi, n, tiny OR lead(tiny) OVER w AS small
    FROM apart WHERE c = 2 WINDOW w AS (PARTITION BY doc_id, page_no, l ORDER BY p)) WHERE hi - lo < 2 * n AND NOT small),
  bodies AS (SELECT doc_id, page_no, l AS g, sum(mid) AS s, count(*) AS cnt FROM apart WHERE c = 2 GROUP BY ALL),
  marks AS (SELECT doc_id, page_no, l, p, x0, mid, n, c, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY l * 3 + 2 - 2 * c, x0, p) AS m FROM apart WHERE tiny AND c < 2),
  fits AS (SELECT r.doc_id, r.page_no, r.m, list(struct_pack(g := g.g, a := a, hi := hi, s := s, cnt := cnt)) AS fit FROM marks r
    JOIN slots g ON g.doc_id = r.doc_id AND g.page_no = r.page_no AND (g.g = r.l OR g.g = r.l + 1 - 2 * r.c) AND r.x0 BETWEEN lo AND hi
    JOIN bodies b ON b.doc_id = g.doc_id AND b.page_no = g.page_no AND b.g = g.g GROUP BY ALL),
  visits AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY turn, x0, m) AS step FROM (
    SELECT marks.*, fit, unnest([l * 3 + 2 - 2 * c, (l + 1 - c) * 3 + 1]) AS turn, unnest([-1, l + 1 - c]) AS here FROM marks JOIN fits USING (doc_id, page_no, m))),
  walk AS (SELECT DISTINCT doc_id, page_no, 0::BIGINT AS step, []::STRUCT(m BIGINT, g BIGINT, x0 DOUBLE, mid DOUBLE, step BIGINT)[] AS held FROM visits UNION ALL
    SELECT doc_id, page_no, step, CASE WHEN here <> cur OR len(list_filter(free, lambda f: f.g = here)) > 0 OR len(near) = 0 THEN held
      ELSE list_append(list_filter(held, lambda q: q.m <> m), struct_pack(m := m, g := near[1].g, x0 := x0, mid := mid, step := step)) END
    FROM (SELECT *, list_sort(list_filter(list_transform(list_filter(free, lambda f: f.g <> here), lambda f: struct_pack(away := abs(mid
        - (f.s + coalesce(list_sum(list_transform(list_filter(held, lambda q: q.g = f.g), lambda q: q.mid)), 0)) / (f.cnt + len(list_filter(held, lambda q: q.g = f.g)))), g := f.g)), lambda o: o.away <= n)) AS near
      FROM (SELECT v.*, held, coalesce(list_filter(held, lambda q: q.m = v.m)[1].g, -1) AS cur,
          list_filter(fit, lambda f: len(list_filter(held, lambda q: q.g = f.g AND q.m <> v.m AND q.x0 >= f.a AND q.x0 < f.hi)) = 0) AS free
        FROM walk w JOIN visits v ON v.doc_id = w.doc_id AND v.page_no = w.page_no AND v.step = w.step + 1))),
  taken AS (SELECT doc_id, page_no, q.m AS m, q.g AS gl, q.step AS since FROM (SELECT doc_id, page_no, unnest(held) AS q FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY step DESC) = 1)),
  home AS (SELECT a.*, coalesce(since, 0) AS since, coalesce(gl, a.l) * 3 + CASE WHEN gl IS NOT NULL OR a.c = 2 THEN 1 WHEN a.c = 1 THEN 0 ELSE 2 END AS k
    FROM apart a LEFT JOIN (SELECT doc_id, page_no, l, p, gl, since FROM taken JOIN marks USING (doc_id, page_no, m)) USING (doc_id, page_no, l, p))
"""


@query("t_reattach", _CHARS + _HOME + "SELECT doc_id, page_no, count(DISTINCT k) AS lines, count(*) AS chars FROM home GROUP BY ALL")
def t_reattach(spark, sf):
    lined = Y.assign_lines(page_chars(spark, sf).drop("l", "p"))
    return lined.groupBy("doc_id", "page_no").agg(F.max("line_no").alias("lines"), F.count("*").alias("chars"))


_LEADS = _STEPS + """, seen AS (SELECT *, last_value(CASE WHEN ch <> ' ' THEN x0 + wide END IGNORE NULLS) OVER w1 AS bx, first_value(CASE WHEN ch <> ' ' THEN x0 END IGNORE NULLS) OVER w2 AS ax,
    last_value(CASE WHEN ch <> ' ' THEN struct_pack(ch := ch, x0 := x0, x1 := x0 + wide, size := size) END IGNORE NULLS) OVER w1 AS pv, lag(ch) OVER w AS before
    FROM chars WINDOW w AS (PARTITION BY doc_id, page_no, l ORDER BY p), w1 AS (PARTITION BY doc_id, page_no, l ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      w2 AS (PARTITION BY doc_id, page_no, l ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  gaps AS (SELECT doc_id, page_no, l, list_sort(list(ax - bx) FILTER (ch = ' ' AND ax - bx > 0 AND ax - bx < 10 * size)) AS g, list_sort(list(size)) AS z FROM seen GROUP BY ALL),
  leads AS (SELECT s.doc_id, s.page_no, s.l, s.p, s.ch, s.bold, s.size, s.y0, s.tall, CASE WHEN s.ch = ' ' OR pv IS NULL OR pv.x1 <= pv.x0 THEN '' WHEN s.x0 - pv.x1 > 2.75 * w THEN 'tab'
      WHEN coalesce(before, '') <> ' ' AND (s.x0 - pv.x0) - a.advance * pv.size > 0.55 * w THEN 'space' ELSE '' END AS lead
    FROM seen s JOIN (SELECT doc_id, page_no, l, coalesce(g[len(g) // 2 + 1], 0.32::DOUBLE * z[len(z) // 2 + 1]) AS w FROM gaps) g USING (doc_id, page_no, l)
    LEFT JOIN adv a ON a.doc_id = s.doc_id AND a.page_no = s.page_no AND a.ch = pv.ch)
"""


@query("w_spaces", _CHARS + _LEADS + """SELECT doc_id, page_no, count(*) FILTER (lead = 'space') AS spaces, count(*) FILTER (lead = 'tab') AS tabs FROM leads GROUP BY ALL""")
def w_spaces(spark, sf):
    lined = page_chars(spark, sf).withColumnsRenamed({"l": "line_no", "p": "pos"})
    spaced = Y.insert_spaces(lined)
    return spaced.groupBy("doc_id", "page_no").agg(
        F.count_if(F.col("lead") == " ").alias("spaces"), F.count_if(F.col("lead") == "\t").alias("tabs"))


# From characters with their line (l, top-down) and their leads to paragraph blocks.
_PARAGRAPHS = """, rows_in AS (SELECT doc_id, page_no, l, max(y0 + tall) AS top, min(y0) AS bottom, avg(tall) AS height FROM leads GROUP BY ALL),
  after AS (SELECT *, lag(bottom) OVER w AS pb, lag(height) OVER w AS ph FROM rows_in WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY l)),
  paras AS (SELECT *, min(l) OVER (PARTITION BY doc_id, page_no, para) AS first FROM (SELECT *, sum(CASE WHEN pb - top > 1.5 * least(height, CASE WHEN ph = 0 THEN height ELSE ph END) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, page_no ORDER BY l) AS para FROM after)),
  glyphs AS (SELECT g.*, para, top, CASE WHEN g.l > first AND row_number() OVER (PARTITION BY doc_id, page_no, g.l ORDER BY g.p) = 1 THEN ' ' ELSE '' END AS joint,
    CASE lead WHEN 'tab' THEN chr(9) WHEN 'space' THEN ' ' ELSE '' END AS ahead FROM leads g JOIN paras USING (doc_id, page_no, l)),
  pieces AS (SELECT doc_id, page_no, para, l, p, 0 AS k, joint AS t, false AS b FROM glyphs WHERE joint <> '' UNION ALL
    SELECT doc_id, page_no, para, l, p, 1, ahead, bold AND lead <> 'tab' FROM glyphs WHERE ahead <> '' UNION ALL SELECT doc_id, page_no, para, l, p, 2, ch, bold FROM glyphs),
  changes AS (SELECT *, CASE WHEN b <> lag(b) OVER (PARTITION BY doc_id, page_no, para ORDER BY l, p, k) THEN 1 ELSE 0 END AS c FROM pieces),
  numbered AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, page_no, para ORDER BY l, p, k) AS run FROM changes),
  texts AS (SELECT doc_id, page_no, para, regexp_replace(string_agg(t, '' ORDER BY l, p, k), '^\\s+|\\s+$', '', 'g') AS text,
    max(run) FILTER (trim(t, chr(9) || ' ') <> '') - min(run) FILTER (trim(t, chr(9) || ' ') <> '') + 1 AS runs FROM numbered GROUP BY ALL),
  sizes AS (SELECT doc_id, page_no, para, max(top) AS y, list_sort(list(size))[count(*) // 2 + 1] AS size FROM glyphs GROUP BY ALL)
  SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, para) AS block_no, text, runs, size FROM texts JOIN sizes USING (doc_id, page_no, para) WHERE text <> ''"""


@query("t_blocks", _CHARS.replace("WITH ", "WITH RECURSIVE ", 1).replace("chars AS (", "placed AS (") + _HOME_BY_VISIT.replace("FROM chars", "FROM placed") + ", chars AS (SELECT * EXCLUDE (mid, since) REPLACE (k AS l, row_number() OVER (PARTITION BY doc_id, page_no, k ORDER BY x0, since, p) AS p) FROM home)" + _LEADS + _PARAGRAPHS)
def t_blocks(spark, sf):
    blocks = Y.build_blocks(page_chars(spark, sf).drop("l", "p"))
    return blocks.select("doc_id", "page_no", "block_no", "text", F.size("runs").alias("runs"), "size")


_LINES = """SELECT doc_id, (page_no - 1) // 20 + 1 AS page_no, page_no AS line_no, length(text) AS n,
  (5000 - page_no * 14 - (page_no // 5) * 9.5 - (page_no // 7) * 4)::DOUBLE AS top, (8 + length(text) % 3)::DOUBLE AS height FROM pages_in"""


def page_lines(spark, sf):
    return text_pages(spark, sf).selectExpr(
        "doc_id", "CAST(floor((page_no - 1) / 20) AS INT) + 1 AS page_no", "page_no AS line_no", "length(text) AS n",
        "CAST(5000 - page_no * 14 - floor(page_no / 5) * 9.5 - floor(page_no / 7) * 4 AS DOUBLE) AS top",
        "CAST(8 + length(text) % 3 AS DOUBLE) AS height").withColumn("bottom", F.col("top") - F.col("height"))


@query("w_paragraphs", cte(pages_in=TEXT_PAGES, lines=_LINES) + """, seen AS (SELECT *, lag(top - height) OVER w AS pb, lag(height) OVER w AS ph FROM lines WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no))
  SELECT doc_id, page_no, line_no, sum(CASE WHEN pb - top > 1.5 * least(height, ph) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS para_no FROM seen""")
def w_paragraphs(spark, sf):
    return Y.number_paragraphs(page_lines(spark, sf)).select("doc_id", "page_no", "line_no", "para_no")


@query("a_median_up", cte(pages_in=TEXT_PAGES, lines=_LINES) + "SELECT doc_id, page_no, list_sort(list(n))[count(*) // 2 + 1] AS median FROM lines GROUP BY ALL")
def a_median_up(spark, sf):
    return Y.upper_median(page_lines(spark, sf), ["doc_id", "page_no"], "n", "median")


_SIZE = "CASE length(text) % 9 WHEN 0 THEN 24.0 WHEN 1 THEN 24.04 WHEN 2 THEN 18.25 WHEN 3 THEN 0.0 WHEN 4 THEN 12.04 WHEN 5 THEN 16.5 ELSE 12.0 END"
_BLOCKS = f"SELECT doc_id, page_no AS block_no, (page_no - 1) // 20 + 1 AS page_no, CAST({_SIZE} AS DOUBLE) AS size FROM pages_in"
_BODY = """, rounded AS (SELECT *, round_even(size, 1) AS s FROM blocks WHERE size > 0), counted AS (SELECT doc_id, s, count(*) AS n, min((page_no, block_no)) AS f FROM rounded GROUP BY ALL),
  body AS (SELECT doc_id, arg_min(s, (-n, f)) AS body_size, max(s) AS largest FROM counted GROUP BY 1)
"""


def blocks(spark, sf):
    return text_pages(spark, sf).selectExpr(
        "doc_id", "page_no AS block_no", "CAST(floor((page_no - 1) / 20) AS INT) + 1 AS page_no", f"CAST({_SIZE} AS DOUBLE) AS size")


@query("a_body_size", cte(pages_in=TEXT_PAGES, blocks=_BLOCKS) + _BODY + "SELECT * FROM body")
def a_body_size(spark, sf):
    return Y.body_sizes(blocks(spark, sf)).filter("body_size IS NOT NULL")


@query("w_heading", cte(pages_in=TEXT_PAGES, blocks=_BLOCKS) + _BODY + """, heads AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r
    FROM (SELECT DISTINCT rounded.doc_id, s FROM rounded JOIN body USING (doc_id) WHERE s >= body_size * 1.25))
  SELECT b.doc_id, b.page_no, b.block_no, CASE WHEN r IS NULL THEN 0 ELSE least(r, 2) END AS level FROM blocks b LEFT JOIN heads h ON h.doc_id = b.doc_id AND h.s = b.size""")
def w_heading(spark, sf):
    all_blocks = blocks(spark, sf)
    return Y.heading_levels(all_blocks, Y.body_sizes(all_blocks)).select("doc_id", "page_no", "block_no", "level")
