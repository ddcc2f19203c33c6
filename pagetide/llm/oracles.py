"""Check SQL of the queries that SQL can express, for the checking engine."""

from __future__ import annotations

# Words: runs of anything but space and U+0009 to U+000D.
_WORDS = r"""list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

_COMPONENTS = """
  walk AS (
    SELECT id, id AS root FROM nodes
    UNION
    SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.id WHERE w.root < l.b
  ),
  roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id)
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
),
d AS (
  SELECT page_id, hex, strlen(body) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)),
      'string_agg', '') AS payload_digest
  FROM p
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings
),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
nodes AS (SELECT id FROM v),
{_COMPONENTS}
SELECT v.id AS vec_id, (SELECT count(*) FROM links WHERE a = v.id) AS n_links, r.root AS component_id,
  v.id = r.root AS kept
FROM v JOIN roots r USING (id)
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50)
),
g AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS first FROM s),
hit AS (SELECT DISTINCT doc_id, pos FROM g WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM hit),
lost AS (SELECT doc_id, list(pos) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS k
  FROM d LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""

NEAR = f"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, {_WORDS.format(
      text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT id, md5_number(array_to_string(w[pos:pos + 3], ' ')) AS h
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS pos FROM d WHERE len(w) > 0)
),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b USING (h) WHERE a.id <> b.id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
),
nodes AS (SELECT id FROM d),
{_COMPONENTS}
SELECT d.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.root AS component_id, d.id = r.root AS kept
FROM d LEFT JOIN n USING (id) JOIN roots r USING (id)
"""

# A run of period q holds at least 3 q - 2 places whose three words come again q words on, so only
# distances found that often are tried as periods.
RUNS = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, crc32_of AS h, {_WORDS.format(text="coalesce(text, '')")} AS w
  FROM (SELECT doc_id, text, CASE WHEN doc_id IS NOT NULL THEN
    list_reduce(list_transform(range(0, length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::BIGINT),
      lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)),
      4294967295::BIGINT) END AS reg, xor(reg, 4294967295::BIGINT) AS crc32_of FROM documents)
),
m AS (
  SELECT k, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d
),
t AS MATERIALIZED (
  SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n),
    lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM m
),
words AS MATERIALIZED (SELECT k, i, w[i + 1] AS w FROM (SELECT k, w, unnest(range(0, n)) AS i FROM t)),
triples AS (
  SELECT k, i, w || chr(10) || lead(w, 1) OVER p || chr(10) || lead(w, 2) OVER p AS x FROM words WINDOW p AS (PARTITION BY k ORDER BY i)
),
repeated AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY k, x) AS c FROM triples WHERE x IS NOT NULL) WHERE c >= 3),
periods AS MATERIALIZED (
  SELECT k, q FROM (SELECT a.k AS k, b.i - a.i AS q, count(*) AS c FROM repeated a
    JOIN repeated b ON a.k = b.k AND a.x = b.x AND a.i < b.i GROUP BY 1, 2) WHERE c >= 3 AND c >= 3 * q - 2
),
equal AS (SELECT p.k, p.q, a.i FROM periods p JOIN words a ON a.k = p.k JOIN words b ON b.k = p.k AND b.i = a.i + p.q WHERE a.w = b.w),
islands AS (
  SELECT k, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM equal) GROUP BY k, q, island
),
found AS MATERIALIZED (
  SELECT k, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY ALL
),
per_document AS (
  SELECT k, count(*) AS n_runs, arg_max([start, length, period], [length, -start, -period]) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM found GROUP BY k
),
dropped AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM found),
kept AS (
  SELECT words.k, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (k, i) GROUP BY words.k
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
  1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN per_document USING (k) LEFT JOIN kept USING (k)
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SEARCH = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
wanted AS MATERIALIZED (SELECT DISTINCT q, unnest(t) AS term FROM i),
totals AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
postings AS MATERIALIZED (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) SEMI JOIN wanted USING (term) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term
),
parts AS MATERIALIZED (
  SELECT k, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * docs) // terms))) AS impact
  FROM postings JOIN weights USING (term) JOIN d USING (k), totals
),
scores AS (SELECT q, k, sum(impact)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY ALL HAVING sum(impact) > 0),
ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores JOIN d USING (k)
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 50
"""
