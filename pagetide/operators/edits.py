"""Fold a log of page edits over documents.

``log(doc_id, seq, action, ids, arg)``: rotations, marks, removals and dividers are
aggregates over "what came last and what came after", so they need no replay. The
whole state of a page is one fold: every edit either sets or adds, such edits compose,
so a busy page is cut into spans of the log that are folded apart and then together.
Only the order of the pages depends on every earlier move; it is folded document by
document in a stream that holds one page list at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_lookup

KEY = ["doc_id", "item"]
# Sequence numbers of one page that may meet in one fold.
SPAN = 65_536
ORDER_ACTIONS = ("init", "append", "move", "set_order", "reverse")


def in_effect(log: DataFrame) -> DataFrame:
    """The edits since each document's last ``init`` (this one included); all of a document that
    has none."""
    starts = log.filter("action = 'init'").groupBy("doc_id").agg(F.max("seq").alias("_start"))
    return salted_lookup(log, starts, ["doc_id"], ["seq"]).filter(
        F.col("_start").isNull() | (F.col("seq") >= F.col("_start")))


def _touches(log: DataFrame, *actions: str, pages: bool = True, each: bool = False) -> DataFrame:
    """One row per (edit, named page). With ``each``, a page named twice gives two rows. Edits of
    ``pages`` count only from when the page came in."""
    ids = F.col("ids") if each else F.array_distinct("ids")
    rows = log.filter(F.col("action").isin(*actions)).select(
        "doc_id", "seq", "action", "arg", "_start", F.explode(ids).alias("item"))
    if not pages:
        return rows
    came = log.filter(F.col("action").isin("init", "append")).select("doc_id", "seq", F.explode("ids").alias("item")).groupBy(
        *KEY).agg(F.min("seq").alias("_came"))
    return salted_lookup(rows, came, KEY, ["seq"]).filter(
        F.col("_start").isNull() | (F.col("seq") > F.col("_came")))


def _last_global(log: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """Newest edit per document among ``actions`` (edits that concern every page)."""
    return log.filter(F.col("action").isin(*actions)).groupBy("doc_id").agg(
        F.max("seq").alias("_gseq"), F.max_by("ids", "seq").alias("_gids"))


def fold_flags(log: DataFrame, toggle: str, set_all: str, clear: str, set_some: str | None = None,
               name: str = "flag", pages: bool = True) -> DataFrame:
    """Flag per touched page (or, without ``pages``, divider): the last absolute value, flipped by
    the toggles after it. A page that one toggle names twice flips twice."""
    log = in_effect(log)
    flips = _touches(log, toggle, pages=pages, each=True)
    base = log.filter(F.col("action").isin(set_all, clear)).withColumn(
        "ids", F.when(F.col("action") == set_all, F.col("ids")).otherwise(F.slice("ids", 1, 0)))
    base = _last_global(base, (set_all, clear))
    own = _touches(log, set_some, pages=pages) if set_some else flips.filter("false")
    own = own.groupBy(*KEY).agg(F.max("seq").alias("_seq"), F.max_by("arg", "seq").alias("_arg"))
    touched = flips.select(*KEY).unionByName(base.select("doc_id", F.explode("_gids").alias("item"))).distinct()
    start = salted_lookup(touched.join(own, KEY, "full_outer"), base, ["doc_id"], ["item"])
    kept = F.coalesce("_seq", F.lit(-1)) > F.coalesce("_gseq", F.lit(-1))
    was = F.when(kept, F.col("_arg") == 1).otherwise(F.coalesce(F.array_contains("_gids", F.col("item")), F.lit(False)))
    after = F.greatest(F.coalesce("_seq", F.lit(-1)), F.coalesce("_gseq", F.lit(-1)))
    start = start.select(*KEY, was.alias("_was"), after.alias("_after"))
    counted = salted_lookup(flips, start.select(*KEY, "_after"), KEY, ["seq"]).filter(
        F.col("seq") > F.col("_after")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    odd: Column = F.coalesce("_n", F.lit(0)) % 2 == 1
    return start.join(counted, KEY, "left").select(*KEY, (F.col("_was") != odd).alias(name))


def fold_mode(log: DataFrame, action: str = "set_mode") -> DataFrame:
    return log.filter(F.col("action") == action).groupBy("doc_id").agg(F.max_by("arg", "seq").alias("mode"))


EFFECT = "struct<turned:boolean,angle:bigint,ruled:boolean,flag:boolean,out:boolean>"
COMPOSED = f"struct<came:boolean,every:{EFFECT},later:{EFFECT}>"


def _effect(action: Column, arg: Column) -> Column:
    """What one edit does to a page: absolute (``turned``, ``ruled``) or relative angle and mark, and
    removal (null: untouched)."""
    turned, ruled = action == "set_angles", action == "set_mark"
    return F.struct(
        turned, F.when(turned, arg).when(action == "rotate", F.coalesce(arg, F.lit(0))).otherwise(0),
        ruled, F.when(ruled, arg == 1).otherwise(action == "toggle_mark"),
        F.when(action.isin("remove", "restore"), action == "remove")).cast(EFFECT)


def _nothing() -> Column:
    return F.struct(*[F.lit(v) for v in (False, 0, False, False, None)]).cast(EFFECT)


def _then(a: Column, b: Column) -> Column:
    """Effect ``a`` followed by effect ``b``."""
    return F.struct(
        a["turned"] | b["turned"], F.when(b["turned"], b["angle"]).otherwise(a["angle"] + b["angle"]),
        a["ruled"] | b["ruled"], F.when(b["ruled"], b["flag"]).otherwise(a["flag"] != b["flag"]),
        F.coalesce(b["out"], a["out"])).cast(EFFECT)


def _compose(edits: Column) -> Column:
    """Fold an ordered array of COMPOSED. ``every`` counts all edits, ``later`` those after the page came in."""
    start = F.struct(F.lit(False), _nothing(), _nothing()).cast(COMPOSED)
    return F.aggregate(edits, start, lambda a, b: F.struct(
        a["came"] | b["came"], _then(a["every"], b["every"]),
        F.when(a["came"], _then(a["later"], b["every"])).otherwise(b["later"])).cast(COMPOSED))


def _per_document(log: DataFrame) -> DataFrame:
    """Start of each document's edits, and the newest edits after it that concern every page."""
    seq = F.col("seq")
    marking = F.col("action").isin("set_marked", "clear_marks")
    named = F.when(F.col("action") == "set_marked", F.col("ids"))
    found = log.filter(F.col("action").isin("init", "reset_angles", "set_marked", "clear_marks")).groupBy("doc_id").agg(
        F.max(F.when(F.col("action") == "init", seq)).alias("_start"),
        F.max(F.when(F.col("action") == "reset_angles", seq)).alias("_reset"),
        F.max(F.when(marking, seq)).alias("_marked"), F.max_by(named, F.when(marking, seq)).alias("_named"))
    in_force = F.col("_start").isNull() | (F.col("_marked") >= F.col("_start"))
    return found.withColumn("_named", F.when(in_force, F.col("_named")))


def fold_state(items: DataFrame, log: DataFrame) -> DataFrame:
    """Angle, delete mark and removal of every page ``items(doc_id, item)``.

    The log is read twice: for the newest edits of each document, and for the edits of each page,
    which move once, by page and span of SPAN sequence numbers. A page that ``log`` does not touch
    has angle 0 and no mark. Of edits with one number, absolute ones count last.
    """
    action, seq = F.col("action"), F.col("seq")
    documents = _per_document(log)
    named = F.when(action == "toggle_mark", F.col("ids")).otherwise(F.array_distinct("ids"))
    edits = log.filter(action.isin("init", "append", "rotate", "set_angles", "toggle_mark", "set_mark", "remove", "restore"))
    beside = salted_lookup(edits, documents.drop("_named"), ["doc_id"], ["seq"])
    after = (F.when(action.isin("rotate", "set_angles"), F.col("_reset")).when(action.isin("toggle_mark", "set_mark"), F.col("_marked")))
    counts = (F.col("_start").isNull() | (seq >= F.col("_start"))) & (after.isNull() | (seq > after))
    came = action.isin("init", "append")
    rank = F.when(came, 2).when(action.isin("set_angles", "set_mark"), 1).otherwise(0)
    effect = _effect(action, F.col("arg"))
    composed = F.struct(came, effect, _nothing()).cast(COMPOSED)
    touched = beside.filter(counts).select(
        "doc_id", F.explode(named).alias("item"), F.floor(seq / SPAN).alias("_span"),
        F.struct("seq", rank.alias("rank"), "arg", composed.alias("does")).alias("_edit"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda e: e["does"])
    spans = touched.groupBy(*KEY, "_span").agg(_compose(ordered("_edit")).alias("does"))
    folded = spans.groupBy(*KEY).agg(_compose(ordered(F.struct("_span", "does"))).alias("_does"))
    out = salted_lookup(items.join(folded, KEY, "left"), documents.select("doc_id", "_start", "_named"), ["doc_id"], ["item"])
    does = F.when(F.col("_start").isNull(), F.col("_does.every")).otherwise(F.col("_does.later"))
    all_marked = F.coalesce(F.array_contains("_named", F.col("item")), F.lit(False))
    marked = F.when(F.col("_e.ruled"), F.col("_e.flag")).otherwise(all_marked != F.coalesce("_e.flag", F.lit(False)))
    no = F.lit(False)
    return out.withColumn("_e", does).select(
        *items.columns, F.coalesce(F.pmod("_e.angle", F.lit(360)), F.lit(0)).alias("angle"),
        F.coalesce(marked, no).alias("marked"), F.coalesce("_e.out", no).alias("removed"))


def _rank(places: dict[int, int], action: str, ids: list[int], arg: int):
    """Sort key of a page under one order edit, given the places before it; None: nothing moves."""
    named = {item: k for k, item in reversed(list(enumerate(ids)))}
    if action == "reverse":
        return lambda item: -places[item]
    if action == "set_order":
        return named.__getitem__ if places.keys() <= named.keys() else None
    # A move: the named pages, in their present order, before the rest's page number ``arg``.
    rest = sorted((p for item, p in places.items() if item not in named))
    if len(rest) == len(places):
        return None
    at = min(max(int(arg), 0), len(rest))
    gap = (rest[at] if at < len(rest) else len(places)) - 0.5
    return lambda item: (gap, places[item]) if item in named else (places[item], 0)


def _reordered(order: list[int], action: str, ids: list[int], arg: int) -> list[int]:
    if action == "init":
        return list(ids)
    if action == "append":
        return list(dict.fromkeys([*order, *ids]))
    key = _rank({item: k for k, item in enumerate(order)}, action, ids, arg)
    return order if key is None else sorted(order, key=key)


def fold_order(log: DataFrame) -> DataFrame:
    """Final place of each page. A document starts with its ``init`` edit.

    Rows arrive by document and sequence in Arrow batches; only order edits are
    shuffled, and memory holds one document's page list.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, order = None, []

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"doc_id": [doc] * len(order), "item": order, "place": range(1, len(order) + 1)})

        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if row.doc_id != doc:
                    if doc is not None:
                        done.append(flush())
                    doc, order = row.doc_id, []
                order = _reordered(order, row.action, [] if row.ids is None else list(row.ids), row.arg)
            if done:
                yield pd.concat(done)
        if doc is not None:
            yield flush()

    moves = log.filter(F.col("action").isin(*ORDER_ACTIONS)).select("doc_id", "seq", "action", "ids", "arg")
    width = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = moves.repartition(width, "doc_id").sortWithinPartitions("doc_id", "seq")
    return spread.mapInPandas(run, "doc_id long, item int, place int")
