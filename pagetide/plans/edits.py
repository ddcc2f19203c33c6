"""Queries over page-edit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from .inputs import source
from .registry import query

_KINDS = ("rotate", "set_angles", "reset_angles", "toggle_mark", "set_mark", "set_marked", "clear_marks", "remove",
          "restore", "move", "reverse", "set_order", "toggle_divider", "set_dividers", "clear_dividers", "rotate", "toggle_mark")
_ACTION = f"split_part('{','.join(_KINDS)}', ',', CAST((event_id * 7 + user_id) % {len(_KINDS)} AS INT) + 1)"
_ARG = "CASE WHEN event_type = 'error' THEN -90 WHEN event_type = 'view' THEN 180 WHEN event_type = 'click' THEN 1 ELSE 90 END"
_A, _B = "CAST(event_id % 8 AS INT) + 1", "CAST((event_id + 2) % 8 AS INT) + 1"


def edit_log(spark, sf):
    """Events as edits of eight-page documents, one document per user."""
    events = source(spark, sf, "events")
    ids = F.array(F.expr(_A), F.expr(_B))
    order = F.when(F.col("event_id") % 2 == 0, F.sequence(F.lit(8), F.lit(1))).otherwise(ids)
    action = F.expr(_ACTION)
    edits = events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), action.alias("action"),
                          F.when(action == "set_order", order).otherwise(ids).alias("ids"), F.expr(_ARG).alias("arg"))
    starts = events.select(F.col("user_id").alias("doc_id")).distinct().select(
        "doc_id", F.lit(-1).cast("long").alias("seq"), F.lit("init").alias("action"),
        F.sequence(F.lit(1), F.lit(8)).alias("ids"), F.lit(0).alias("arg"))
    return edits.unionByName(starts)


def items(spark, sf):
    return source(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct().select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("item"))


_LOG = f"""WITH log AS (SELECT user_id AS doc_id, event_id AS seq, {_ACTION} AS action, {_A} AS a, {_B} AS b, {_ARG} AS arg FROM events),
  items AS (SELECT DISTINCT user_id AS doc_id, unnest(range(1, 9)) AS item FROM events),
  touch AS (SELECT doc_id, seq, action, arg, unnest([a, b]) AS item FROM log)
"""


@query("t_edit_fold", _LOG + """SELECT i.doc_id, i.item,
  (((coalesce((SELECT CASE WHEN t.action = 'set_angles' THEN t.arg ELSE 0 END FROM (SELECT seq, action, arg FROM touch WHERE doc_id = i.doc_id AND item = i.item AND action = 'set_angles'
      UNION ALL SELECT seq, action, arg FROM log WHERE doc_id = i.doc_id AND action = 'reset_angles') t ORDER BY t.seq DESC LIMIT 1), 0)
    + coalesce((SELECT sum(arg) FROM touch r WHERE r.doc_id = i.doc_id AND r.item = i.item AND action = 'rotate' AND seq > (SELECT coalesce(max(seq), -1) FROM touch s WHERE s.doc_id = i.doc_id
      AND (action = 'reset_angles' OR (action = 'set_angles' AND s.item = i.item)))), 0)) % 360) + 360) % 360 AS angle,
  (coalesce((SELECT CASE WHEN t.action = 'set_mark' THEN t.arg = 1 WHEN t.action = 'set_marked' THEN i.item IN (a, b) ELSE false END FROM log t WHERE doc_id = i.doc_id
      AND (action IN ('set_marked', 'clear_marks') OR (action = 'set_mark' AND i.item IN (a, b))) ORDER BY seq DESC LIMIT 1), false)::INT
    + (SELECT count(*) FROM touch r WHERE r.doc_id = i.doc_id AND r.item = i.item AND action = 'toggle_mark' AND seq > (SELECT coalesce(max(seq), -1) FROM log s WHERE s.doc_id = i.doc_id
      AND (action IN ('set_marked', 'clear_marks') OR (action = 'set_mark' AND i.item IN (a, b)))))) % 2 = 1 AS marked,
  coalesce((SELECT action = 'remove' FROM touch t WHERE t.doc_id = i.doc_id AND t.item = i.item AND action IN ('remove', 'restore') ORDER BY seq DESC LIMIT 1), false) AS removed
  FROM items i""")
def t_edit_fold(spark, sf):
    return E.fold_state(items(spark, sf), edit_log(spark, sf))


@query("t_edit_dividers", _LOG + """SELECT doc_id, item, flag FROM (SELECT i.doc_id, i.item,
  (coalesce((SELECT CASE WHEN t.action = 'set_dividers' THEN i.item IN (a, b) ELSE false END FROM log t WHERE doc_id = i.doc_id AND action IN ('set_dividers', 'clear_dividers') ORDER BY seq DESC LIMIT 1), false)::INT
    + (SELECT count(*) FROM touch r WHERE r.doc_id = i.doc_id AND r.item = i.item AND action = 'toggle_divider' AND seq > (SELECT coalesce(max(seq), -1) FROM log s WHERE s.doc_id = i.doc_id
      AND action IN ('set_dividers', 'clear_dividers')))) % 2 = 1 AS flag FROM items i WHERE item < 8) WHERE flag""")
def t_edit_dividers(spark, sf):
    flags = E.fold_flags(edit_log(spark, sf), "toggle_divider", "set_dividers", "clear_dividers", pages=False)
    return flags.filter("flag AND item BETWEEN 1 AND 7")


# The order depends on all earlier moves, so SQL follows the order edits of a document one by one.
@query("t_edit_order", _LOG + """, moves AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM log WHERE action IN ('move', 'reverse', 'set_order')),
  fold AS (WITH RECURSIVE f AS (
    SELECT DISTINCT doc_id, 0::BIGINT AS r, range(1, 9) AS o FROM items
    UNION ALL SELECT m.doc_id, m.r, CASE m.action WHEN 'reverse' THEN list_reverse(f.o) WHEN 'set_order' THEN CASE WHEN m.seq % 2 = 0 THEN list_reverse(range(1, 9)) ELSE f.o END
      ELSE list_concat(list_concat(list_filter(f.o, lambda x: x NOT IN (m.a, m.b))[1:least(greatest(m.arg, 0), 6)], list_filter(f.o, lambda x: x IN (m.a, m.b))),
        list_filter(f.o, lambda x: x NOT IN (m.a, m.b))[least(greatest(m.arg, 0), 6) + 1:]) END
    FROM f JOIN moves m ON m.doc_id = f.doc_id AND m.r = f.r + 1)
    SELECT doc_id, arg_max(o, r) AS o FROM f GROUP BY doc_id)
  SELECT doc_id, unnest(o) AS item, generate_subscripts(o, 1) AS place FROM fold""")
def t_edit_order(spark, sf):
    return E.fold_order(edit_log(spark, sf))
