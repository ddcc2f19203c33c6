"""From placed characters to lines, spaces, paragraphs and headings.

The greedy line clustering needs Python, one page at a time. Blocks are built from
lines, which that same pass hands over with their text; everything after it is window
and aggregate work on lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.glyphs import table_width
from ..session import store
from .skew import piece_of, previous_value, running_total, salted_lookup, with_document_options

# Layout thresholds.
LINE_TOLERANCE = 0.35
PARAGRAPH_GAP = 1.5
HEADING_RATIO = 1.25
SPACE_EXTRA = 0.55
GUTTER = 2.75
SPACE_WIDTH = 0.32
TINY = 0.45

PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_no"]
CHAR_SCHEMA = ("doc_id long, page_no int, ch string, x0 double, y0 double, x1 double, y1 double, "
               "size double, bold boolean")


# ------------------------------------------------------------------- lines

def _cluster(y_mid: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Line index per glyph (glyphs come top-down): the nearest line whose running
    mean lies within tolerance, else a new line. Lines out of reach of all further
    glyphs leave the search."""
    tall = np.maximum(height, 1.0)
    reach = LINE_TOLERANCE * tall.max()
    owner, mean, box, members, active = [], [], [], [], []
    for y, h in zip(y_mid.tolist(), tall.tolist()):
        while active and mean[active[0]] - y > reach:
            active.pop(0)
        best, nearest = -1, np.inf
        for k in active:
            away = abs(y - mean[k])
            if away <= LINE_TOLERANCE * max(h, box[k]) and away < nearest:
                best, nearest = k, away
        if best < 0:
            best = len(mean)
            active.append(best)
            mean.append(y)
            box.append(h)
            members.append(1)
        else:
            members[best] += 1
            mean[best] += (y - mean[best]) / members[best]
        owner.append(best)
    return np.array(owner)


def _gaps(line: np.ndarray, box: dict[str, np.ndarray], normal: float) -> tuple[np.ndarray, np.ndarray]:
    """Left and right edges of the narrow gaps between full-size neighbours of a line."""
    a, b = line[:-1], line[1:]
    left, right, height = box["x1"][a], box["x0"][b], box["h"]
    real = (np.minimum(height[a], height[b]) >= TINY * normal) & (right - left < 2.0 * normal)
    return left[real], right[real]


def _within(x: float, gaps: tuple[np.ndarray, np.ndarray]) -> bool:
    return bool(((gaps[0] <= x) & (x <= gaps[1])).any())


def _reattach(lines: list[np.ndarray], box: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Give each tiny glyph that stands in no gap of its own line to the nearest line, at most a
    normal height away, that has a gap around it. Lines are visited top-down and stay in order."""
    inked = np.sort(box["h"][(box["h"] > 0) & ~box["blank"]])
    if not len(inked):
        return lines
    normal, x0 = inked[len(inked) // 2], box["x0"]
    tiny = (box["h"] < TINY * normal) & ~box["blank"]
    gaps = [_gaps(line, box, normal) for line in lines]
    level = np.array([box["mid"][line].mean() for line in lines])
    for here in range(len(lines)):
        for glyph in lines[here][tiny[lines[here]]]:
            rest = lines[here][lines[here] != glyph]
            if _within(x0[glyph], _gaps(rest, box, normal)):
                continue
            away = np.abs(level - box["mid"][glyph])
            away[here] = np.inf
            near = [k for k in np.argsort(away, kind="stable") if away[k] <= normal]
            home = next((k for k in near if _within(x0[glyph], gaps[k])), None)
            if home is None:
                continue
            lines[here] = rest
            place = np.searchsorted(x0[lines[home]], x0[glyph], side="right")
            lines[home] = np.insert(lines[home], place, glyph)
            for k in (here, home):
                gaps[k] = _gaps(lines[k], box, normal)
                level[k] = box["mid"][lines[k]].mean() if len(lines[k]) else np.inf
    return lines


def _found_lines(page: pd.DataFrame, reattach: bool) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The page's glyphs top-down, and the places of each line's glyphs, left to right."""
    y0, y1 = page.y0.to_numpy(), page.y1.to_numpy()
    order = np.lexsort((page.x0.to_numpy(), -(y0 + y1) / 2))
    page, y0, y1 = page.iloc[order], y0[order], y1[order]
    box = {"x0": page.x0.to_numpy(), "x1": page.x1.to_numpy(), "mid": (y0 + y1) / 2, "h": y1 - y0,
           "blank": (page.ch == " ").to_numpy()}
    owner = _cluster(box["mid"], box["h"])
    in_row = lambda line: line[np.argsort(box["x0"][line], kind="stable")]
    top_down = lambda found: sorted(found, key=lambda line: -box["mid"][line].mean())
    members = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner))[:-1])
    lines = top_down(in_row(line) for line in members)
    if reattach:
        lines = top_down(line for line in _reattach(lines, box) if len(line))
    return page, lines


def _page_lines(page: pd.DataFrame, reattach: bool) -> pd.DataFrame:
    page, lines = _found_lines(page, reattach)
    line_no, pos = np.empty(len(page), dtype=np.int64), np.empty(len(page), dtype=np.int64)
    for k, line in enumerate(lines, start=1):
        line_no[line], pos[line] = k, np.arange(1, len(line) + 1)
    return page.assign(line_no=line_no, pos=pos)


def by_page(df: DataFrame) -> DataFrame:
    """Partition by page, once. Every window and group below is keyed by a page or a
    part of it, so none of them moves rows again. The width is explicit, because the
    stages are bound by work per row and would otherwise be merged for small inputs."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *PAGE)


# Bytes of a batch of pages that a task hands to Python; a larger page is a batch of its own.
BATCH_BYTES = 4 << 20


def _each_page(chars: DataFrame, rule: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``rule`` on the characters of each page. A page reaches Python as one row with a list, many
    pages to a batch, which spares the cost a page of a grouped call. Batches end by bytes, so that
    a worker holds no more however many pages a task has. Identifiers pass beside it."""
    chars.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    glyph = [c for c in chars.columns if c not in PAGE]
    pages = by_page(chars).groupBy(*PAGE).agg(F.collect_list(F.struct(*glyph)).alias("_glyphs"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(2)
            flat = pd.DataFrame({n: v.to_pandas() for n, v in zip(glyph, held.flatten().flatten())})
            edges = np.cumsum(np.append(0, held.value_lengths().to_numpy()))
            found = [rule(flat.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            rows, lengths = pd.concat(found, ignore_index=True), [len(f) for f in found]
            page = pa.array(np.repeat(np.arange(len(found)), lengths))
            columns = [batch.column(arrow.names[k]).take(page).cast(arrow.types[k]) for k in range(2)]
            columns += [pa.array(rows[f.name], f.type, from_pandas=True) for f in list(arrow)[2:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pages.select(*PAGE, "_glyphs").mapInArrow(run, schema)


def assign_lines(chars: DataFrame, reattach: bool = True) -> DataFrame:
    """Characters with the line (top-down) and place (left to right) they belong to.

    The clustering is sequential inside a page and independent across pages, so the
    group is one physical page.
    """
    def rule(page: pd.DataFrame) -> pd.DataFrame:
        return _page_lines(page, reattach)

    return _each_page(chars, rule, CHAR_SCHEMA + ", line_no long, pos long")


# ------------------------------------------------------------------ spacing

# Most different values of a group that are put in order in one task; BINS of a narrowing round.
ORDERED_VALUES, BINS = 100_000, 1_024


def _narrowed(counted: DataFrame, stats: DataFrame) -> DataFrame:
    """``counted`` (_key, _value, _n, _goal) with groups of too many values cut to the one of BINS
    equal spans that holds the place ``_goal``; the goal counts from its start."""
    wide = stats.filter(F.col("_different") > ORDERED_VALUES).select("_key", "_low", "_high")
    beside = salted_lookup(counted, wide, ["_key"], ["_value"])
    at = (F.col("_value").cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    binned = beside.withColumn("_bin", F.when(F.col("_high").isNotNull(), F.least(F.floor(at * BINS), F.lit(BINS - 1))))
    sums = binned.filter("_bin IS NOT NULL").groupBy("_key", "_bin", "_goal").agg(F.sum("_n").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bin"))
    held = sums.withColumn("_upto", upto).filter("_upto > _goal AND _upto - _sum <= _goal").select(
        "_key", F.col("_bin").alias("_held"), (F.col("_upto") - F.col("_sum")).alias("_below"))
    chosen = salted_lookup(binned, held, ["_key"], ["_value"]).filter("_bin IS NULL OR _bin = _held")
    return chosen.select("_key", "_value", "_n", (F.col("_goal") - F.coalesce("_below", F.lit(0))).alias("_goal"))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``sorted[n // 2]`` of the non-null numbers of each group.

    Equal values are counted first. A group that still has more than ORDERED_VALUES different ones
    is narrowed by histograms, round by round, to the span around its median, so no task ever
    orders more; each round divides the span by BINS.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_key"), F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n"))
    counted = store(counted, "counted")
    totals = counted.groupBy("_key").agg(F.floor(F.sum("_n") / 2).alias("_goal"))
    held = salted_lookup(counted, totals, ["_key"], ["_value"])
    while True:
        stats = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_different"), F.min("_value").cast("double").alias("_low"),
                                         F.max("_value").cast("double").alias("_high"))
        if stats.filter((F.col("_different") > ORDERED_VALUES) & (F.col("_low") < F.col("_high"))).isEmpty():
            break
        held = store(_narrowed(held, stats), "narrowed")
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_value"))
    return held.withColumn("_upto", upto).filter("_upto > _goal").groupBy("_key").agg(
        F.min("_value").alias(name)).select("_key.*", name)


def _median_beside(value: str, keys: list[str]) -> Column:
    """``sorted[n // 2]`` of the non-null values of a (page-bound) group, on every row. From the top
    that is the first value that half of them reach; it needs no order of the rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC) OVER (PARTITION BY {', '.join(keys)})")


def with_advances(lined: DataFrame) -> DataFrame:
    """Add ``advance``: typical step of the character on its page, per font size.

    The second smallest observed step (the smallest of fewer than four) beats the
    table when it is narrower.
    """
    row = Window.partitionBy(*LINE).orderBy("pos")
    step = (F.lead("x0").over(row) - F.col("x0")) / F.col("size")
    stepped = lined.withColumns({"_table": table_width(F.col("ch")), "_step": F.when(F.col("size") > 0, step)})
    good = (F.col("_step") > 0) & (F.col("ch") != " ") & (F.col("_step") >= 0.5 * F.col("_table"))
    seen = stepped.withColumn("_good", F.when(good, F.col("_step")))
    # One order and one frame for all three, so that a single pass over the sorted group gives them.
    whole = Window.partitionBy(*PAGE, "ch").orderBy(F.asc_nulls_last("_good")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    placed = seen.withColumns({"_n": F.count("_good").over(whole), "_least": F.nth_value("_good", 1).over(whole),
                               "_next": F.nth_value("_good", 2).over(whole)})
    observed = F.when(F.col("_n") < 4, F.col("_least")).otherwise(F.col("_next"))
    return placed.withColumn("advance", F.least(F.coalesce(observed, F.col("_table")), F.col("_table"))).drop(
        "_table", "_good", "_n", "_least", "_next")


def estimate_advances(lined: DataFrame) -> DataFrame:
    """Advance per (page, character) that was seen before another glyph."""
    seen = with_advances(lined).filter((F.col("_step") > 0) & (F.col("ch") != " "))
    return seen.groupBy(*PAGE, "ch").agg(F.first("advance").alias("advance"))


def with_space_width(lined: DataFrame) -> DataFrame:
    """Add the width of a word space on the line: from real spaces, else from the font size."""
    row = Window.partitionBy(*LINE).orderBy("pos")
    ink = F.col("ch") != " "
    before = F.last(F.when(ink, F.col("x1")), True).over(row.rowsBetween(Window.unboundedPreceding, -1))
    # Backwards, the next glyph is a running value too; a frame up to the end is read anew for every row.
    back = Window.partitionBy(*LINE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(ink, F.col("x0")), True).over(back)
    size = F.when(F.col("size") == 0, 10.0).otherwise(F.col("size"))
    gap = F.when(~ink & (F.col("_gap") > 0) & (F.col("_gap") < 10 * size), F.col("_gap"))
    sized = F.when(F.col("size") > 0, F.col("size"))
    seen = lined.withColumn("_gap", after - before).withColumns({"_wide": gap, "_sized": sized})
    both = seen.withColumns({"_real": _median_beside("_wide", LINE), "_font": _median_beside("_sized", LINE)})
    width = F.coalesce("_real", SPACE_WIDTH * F.coalesce("_font", F.lit(10.0)))
    return both.withColumn("space_width", width).drop("_gap", "_wide", "_sized", "_real", "_font")


def insert_spaces(lined: DataFrame) -> DataFrame:
    """Add ``lead``, the text that precedes each glyph: a tab at column gutters, a space
    where the step is wider than the glyph accounts for, else nothing."""
    seen = with_space_width(with_advances(lined))
    row = Window.partitionBy(*LINE).orderBy("pos")
    ink = F.col("ch") != " "
    prev = F.last(F.when(ink, F.struct("x0", "x1", "size", "advance")), True).over(
        row.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumns({"_prev": prev, "_after_space": F.coalesce(F.lag("ch").over(row) == " ", F.lit(False))})
    size = F.when(F.col("_prev.size") == 0, 10.0).otherwise(F.col("_prev.size"))
    extra = F.col("x0") - F.col("_prev.x0") - F.col("_prev.advance") * size
    lead = (
        F.when(~ink | F.col("_prev").isNull() | (F.col("_prev.x1") <= F.col("_prev.x0")), "")
        .when(F.col("x0") - F.col("_prev.x1") > GUTTER * F.col("space_width"), "\t")
        .when(~F.col("_after_space") & (extra > SPACE_EXTRA * F.col("space_width")), " ")
        .otherwise("")
    )
    return seen.withColumn("lead", lead).drop("_prev", "_after_space", "_step", "advance", "space_width")


# --------------------------------------------------------------- line table

LINE_SCHEMA = ("doc_id long, page_no int, line_no long, top double, bottom double, height double, "
               "sizes array<double>, run_text array<string>, run_bold array<boolean>")


def _upper_middle(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """``sorted[n // 2]`` of the values of each group; NaN for a group without any."""
    order = np.lexsort((value, group))
    n = np.bincount(group, minlength=groups)
    at = np.cumsum(n) - n + n // 2
    out = np.full(groups, np.nan)
    out[n > 0] = value[order][at[n > 0]]
    return out


def _advances(code: np.ndarray, step: np.ndarray, table: np.ndarray, ink: np.ndarray) -> np.ndarray:
    """The advance of each glyph by the rule of ``with_advances``."""
    good = (step > 0) & ink & (step >= 0.5 * table)
    observed = np.full(len(code), np.inf)
    if good.any():
        order = np.lexsort((step[good], code[good]))
        seen, start, n = np.unique(code[good][order], return_index=True, return_counts=True)
        typical = np.full(code.max() + 1, np.inf)
        typical[seen] = step[good][order][start + (n >= 4)]
        observed = typical[code]
    return np.minimum(observed, table)


def _leads(g: dict[str, np.ndarray], line: np.ndarray, lines: int) -> np.ndarray:
    """The text before each glyph by the rule of ``insert_spaces``; glyphs come line by line."""
    n, at = len(line), np.arange(len(line))
    start = np.searchsorted(line, line, side="left")
    end = np.searchsorted(line, line, side="right")
    ink, x0, x1 = g["ink"], g["x0"], g["x1"]
    points = np.where(g["size"] == 0, 10.0, g["size"])
    follows = np.append(line[1:] == line[:-1], False)
    step = np.where(follows & (g["size"] > 0), (np.append(x0[1:], np.nan) - x0) / np.where(g["size"] > 0, g["size"], np.nan), np.nan)
    advance = _advances(g["code"], step, g["table"], ink)
    before = np.append(-1, np.maximum.accumulate(np.where(ink, at, -1))[:-1])
    after = np.append(np.minimum.accumulate(np.where(ink, at, n)[::-1])[::-1][1:], n)
    known, ahead = before >= start, after < end
    gap = np.where(known & ahead, x0[np.minimum(after, n - 1)] - x1[before], np.nan)
    wide = ~ink & (gap > 0) & (gap < 10 * points)
    sized = g["size"] > 0
    real, font = _upper_middle(line[wide], gap[wide], lines), _upper_middle(line[sized], g["size"][sized], lines)
    blank = np.where(np.isnan(real), SPACE_WIDTH * np.where(np.isnan(font), 10.0, font), real)[line]
    beside = ink & known & ~(x1[before] <= x0[before])
    gutter = beside & (x0 - x1[before] > GUTTER * blank)
    spaced = np.append(False, follows[:-1] & (g["ch"][:-1] == " "))
    extra = x0 - x0[before] - advance[before] * points[before]
    return np.where(gutter, "\t", np.where(beside & ~spaced & (extra > SPACE_EXTRA * blank), " ", "")).astype(object)


def _line_table(page: pd.DataFrame) -> pd.DataFrame:
    """One row per line of a page: its box, the sizes of its glyphs, and its text in bold and plain runs."""
    page, lines = _found_lines(page, True)
    row = page.iloc[np.concatenate(lines)]
    count = np.array([len(line) for line in lines])
    line, first = np.repeat(np.arange(len(lines)), count), np.cumsum(count) - count
    ch, bold = row.ch.fillna("").to_numpy(dtype=object), row.bold.eq(True).to_numpy(dtype=bool)
    y0, y1, size = row.y0.to_numpy(), row.y1.to_numpy(), row["size"].to_numpy()
    lead = _leads({"x0": row.x0.to_numpy(), "x1": row.x1.to_numpy(), "size": size, "table": row.advance.to_numpy(),
                   "ink": (row.ch.notna() & (row.ch != " ")).to_numpy(), "ch": ch, "code": pd.factorize(ch)[0]}, line, len(lines))
    piece = np.column_stack([lead, ch]).ravel()
    heavy = np.column_stack([bold & (lead != "\t"), bold]).ravel()
    solid = piece != ""
    piece, heavy, owner = piece[solid], heavy[solid], np.repeat(line, 2)[solid]
    starts = np.flatnonzero(np.append(True, (heavy[1:] != heavy[:-1]) | (owner[1:] != owner[:-1]))) if len(piece) else np.array([], dtype=int)
    texts = ["".join(part) for part in np.split(piece, starts[1:])] if len(piece) else []
    runs = np.searchsorted(owner[starts], np.arange(len(lines) + 1))
    return pd.DataFrame({
        "line_no": np.arange(1, len(lines) + 1),
        "top": np.maximum.reduceat(y1, first), "bottom": np.minimum.reduceat(y0, first),
        "height": np.add.reduceat(y1 - y0, first) / count,
        "sizes": [part[part > 0] for part in np.split(size, first[1:])],
        "run_text": [texts[a:b] for a, b in zip(runs[:-1], runs[1:])],
        "run_bold": [heavy[starts[a:b]] for a, b in zip(runs[:-1], runs[1:])]})


def text_lines(chars: DataFrame) -> DataFrame:
    """One row per line: box, glyph sizes, and text with spaces and tabs put back, as runs of one weight.

    One pass over the characters of each page; ``with_advances`` and ``insert_spaces``
    state the same rules as column expressions.
    """
    return _each_page(chars.withColumn("advance", table_width(F.col("ch"))), _line_table, LINE_SCHEMA)


# --------------------------------------------------------------- paragraphs

def _starts_paragraph(previous: Column, top: Column, height: Column) -> Column:
    """1 where the gap below the previous line is wide; ``previous(bottom, height)``."""
    before = F.when(previous["height"] == 0, height).otherwise(previous["height"])
    wide = previous["bottom"] - top > PARAGRAPH_GAP * F.least(height, before)
    return F.coalesce(wide, F.lit(False)).cast("int")


def number_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraph number per line (from 0) of a line table."""
    piece, order = piece_of(F.col("line_no")), [F.col("line_no")]
    seen = previous_value(lines, PAGE, piece, order, F.struct("bottom", "height"), "_prev")
    marked = seen.withColumn("_break", _starts_paragraph(F.col("_prev"), F.col("top"), F.col("height")))
    return running_total(marked, PAGE, piece, order, F.col("_break"), "para_no").drop("_prev", "_break")


def build_blocks(chars: DataFrame) -> DataFrame:
    """Paragraph blocks of each page in reading order, with text, bold runs and size.

    Characters move once, to their page; what moves after that are lines, once more, and every
    window and group is keyed by the page or a part of it.
    """
    para = [*PAGE, "para_no"]
    reading, whole = Window.partitionBy(*PAGE).orderBy("line_no"), Window.partitionBy(*para)
    above = F.lag(F.struct("bottom", "height")).over(reading)
    lines = text_lines(chars).withColumn("_above", above)
    lines = lines.withColumn("para_no", F.sum(_starts_paragraph(F.col("_above"), F.col("top"), F.col("height"))).over(reading))
    lines = lines.withColumns({"y": F.max("top").over(whole), "_first": F.min("line_no").over(whole)})
    runs = F.transform(F.arrays_zip("run_text", "run_bold"), lambda r: F.struct(r["run_text"].alias("text"), r["run_bold"].alias("bold")))
    joint = F.array(F.struct(F.lit(" ").alias("text"), F.lit(False).alias("bold")))
    joined = F.when(F.col("line_no") > F.col("_first"), F.concat(joint, runs)).otherwise(runs)
    pieces = lines.select(*para, "y", "sizes", "line_no", F.posexplode(joined).alias("k", "t")).select(
        *para, "y", F.when(F.col("k") == 0, F.col("sizes")).alias("sizes"), "line_no", "k", "t.text", "t.bold")
    order = Window.partitionBy(*para).orderBy("line_no", "k")
    change = F.coalesce((F.col("bold") != F.lag("bold").over(order)).cast("int"), F.lit(0))
    runs = pieces.withColumn("_c", change).withColumn("run_no", F.sum("_c").over(order))
    texts = _ordered_text(runs, [*para, "run_no", "bold"]).groupBy(*para).agg(
        F.max("y").alias("y"), F.array_sort(F.flatten(F.collect_list("sizes"))).alias("_sizes"),
        F.array_sort(F.collect_list(F.struct("run_no", "text", "bold"))).alias("_r"))
    size = F.coalesce(F.get("_sizes", F.floor(F.size("_sizes") / 2).cast("int")), F.lit(0.0))
    plain = F.array_join(F.transform("_r", lambda r: r["text"]), "")
    out = texts.select(*para, "y", size.alias("size"), _trim(plain).alias("text"), _trim_runs(F.col("_r")).alias("runs"))
    top_down = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "para_no")
    return out.filter("text <> ''").withColumn("block_no", F.row_number().over(top_down))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _ordered_text(pieces: DataFrame, keys: list[str]) -> DataFrame:
    item = F.struct("line_no", "k", "text")
    return pieces.groupBy(*keys).agg(
        F.max("y").alias("y"), F.flatten(F.collect_list("sizes")).alias("sizes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda t: t["text"]), "").alias("text"))


def _trim_runs(runs: Column) -> Column:
    """Blank runs at the ends go; the outer runs lose their outer blanks."""
    solid = F.transform(runs, lambda r: F.when(r["text"].rlike(r"(?U)\S"), r["run_no"]))
    first, last = F.array_min(solid), F.array_max(solid)
    kept = F.filter(runs, lambda r: r["run_no"].between(first, last))

    def cut(r: Column) -> Column:
        text = F.when(r["run_no"] == first, F.regexp_replace(r["text"], r"(?U)^\s+", "")).otherwise(r["text"])
        text = F.when(r["run_no"] == last, F.regexp_replace(text, r"(?U)\s+$", "")).otherwise(text)
        return F.struct(text.alias("text"), r["bold"].alias("bold"))

    return F.transform(kept, cut)


# ----------------------------------------------------------------- headings

def body_sizes(blocks: DataFrame) -> DataFrame:
    """Most common block size (one decimal) per document, ties by first appearance,
    and the largest size. ``blocks(doc_id, page_no, block_no, size)``."""
    rounded = F.bround("size", 1)
    counted = blocks.groupBy("doc_id", F.when(F.col("size") > 0, rounded).alias("_s")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page_no", "block_no")).alias("_first"))
    known = F.when(F.col("_s").isNotNull(), F.struct(-F.col("n"), "_first"))
    return counted.groupBy("doc_id").agg(F.min_by("_s", known).alias("body_size"), F.max("_s").alias("largest"))


def heading_levels(blocks: DataFrame, sizes: DataFrame, compatible: bool = True) -> DataFrame:
    """0 for body text, 1 for the largest heading size, 2 for all smaller ones.

    Levels are capped at two, so no ranking is needed: a size is either the largest
    or another one. ``compatible`` compares the unrounded size with the rounded list.
    """
    joined = with_document_options(blocks, sizes)
    size = F.col("size") if compatible else F.bround("size", 1)
    listed = (size == F.bround("size", 1)) & (size > 0)
    heading = F.coalesce(listed & (size >= F.col("body_size") * HEADING_RATIO), F.lit(False))
    level = F.when(~heading, 0).when(size == F.col("largest"), 1).otherwise(2)
    return joined.withColumn("level", level).drop("page_count", "body_size", "largest")


def mark_no_text(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents without any text block."""
    return pages.select("doc_id").distinct().join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")
