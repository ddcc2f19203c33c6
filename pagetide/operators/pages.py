"""Whole document sets as ordered page rows: select, delete, reorder, merge, split, number.

Pages are numbered 1..n per document without gaps. Most operators need only the
options of their document beside each page; new page numbers then follow by
arithmetic on the option, without a window over the pages.

A document whose options are wrong yields one row that carries its error code
and no page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import ranges as R
from ..functions import values as V
from .skew import (beside_pages, document_options, number_rows, page_counts, running_totals,
                   with_document_options)


def checked_options(pages: DataFrame, options: DataFrame, code: Column, **columns: Column) -> DataFrame:
    """One row per document: options, ``error_code`` and further ``columns`` worked out from the
    options once, so that nothing is parsed beside each page. Documents without pages are
    ``missing_input``."""
    return document_options(pages, options).withColumns(
        {"error_code": F.when(F.col("page_count") == 0, S.MISSING_INPUT).otherwise(code), **columns})


def _emit(pages: DataFrame, checked: DataFrame, keep: Column, columns: dict[str, Column]) -> DataFrame:
    """Kept pages of good documents, and one row with its code for each bad one."""
    good = beside_pages(pages, checked.filter("error_code IS NULL").drop("error_code"))
    rows = good.filter(keep).select("doc_id", *[c.alias(n) for n, c in columns.items()],
                                    F.lit(None).cast("string").alias("error_code"))
    bad = checked.filter("error_code IS NOT NULL").select("doc_id", "error_code")
    return rows.unionByName(bad, allowMissingColumns=True)


def select_pages(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Pages named by ``spec``; a blank spec names all."""
    checked = checked_options(pages, options, R.spec_code(F.col("spec"), F.col("page_count"), blank_ok=True), _iv=R.parsed(F.col("spec")))
    return _emit(pages, checked, R.contains_page(F.col("_iv"), F.col("page_no"), blank_means_all=True),
                 {"page_no": F.col("page_no"), "text": F.col("text")})


def delete_pages(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Remaining pages, renumbered: the old number less the deleted pages before it."""
    code = (
        F.when(R.is_blank(F.col("spec")), S.MISSING_OPTION)
        .otherwise(F.coalesce(
            R.spec_code(F.col("spec"), F.col("page_count"), code=S.BAD_OPTION),
            F.when(R.selected_count(F.col("spec")) >= F.col("page_count"), S.BAD_OPTION),
        ))
    )
    checked = checked_options(pages, options, code, _iv=R.parsed(F.col("spec")))
    return _emit(pages, checked, ~R.contains_page(F.col("_iv"), F.col("page_no")),
                 {"old_page_no": F.col("page_no"), "page_no": F.col("page_no") - R.pages_before(F.col("_iv"), F.col("page_no")), "text": F.col("text")})


def rotate_pages(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Add one quarter-turn ``angle`` to the selected pages (blank spec: all)."""
    angle = F.trim(F.col("angle")).try_cast("int")
    code = F.when(V.blank_to_null(F.col("angle")).isNull(), S.MISSING_OPTION).otherwise(F.coalesce(
        F.when(~F.coalesce(V.is_quarter_turn(angle), F.lit(False)), S.BAD_OPTION),
        R.spec_code(F.col("spec"), F.col("page_count"), blank_ok=True, code=S.BAD_OPTION),
    ))
    checked = checked_options(pages, options, code, _iv=R.parsed(F.col("spec")), _turn=angle)
    turned = F.when(R.contains_page(F.col("_iv"), F.col("page_no"), blank_means_all=True),
                    V.normal_angle(F.col("rotation") + F.col("_turn"))).otherwise(F.col("rotation"))
    return _emit(pages, checked, F.lit(True), {"page_no": F.col("page_no"), "rotation": turned})


def rotate_by_map(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Per-page angles from a JSON object ``{page: angle}``; of several angles for one page,
    however its number is written, the last holds."""
    entries = F.map_entries(F.from_json("rotations", "map<string,variant>"))

    def turn(e: Column) -> Column:
        page, angle = V.strip(e["key"]), e["value"]
        return F.struct(
            F.when(page.rlike(r"\A[+-]?\d+\z"), page.try_cast("int")).alias("page"),
            # an angle given as text is not a number
            F.when(F.schema_of_variant(angle) == "BIGINT", F.try_variant_get(angle, "$", "int")).alias("angle"))

    def bad(t: Column) -> Column:
        return ~F.coalesce(t["page"].between(1, F.col("page_count")) & t["angle"].isin(90, 180, 270), F.lit(False))

    code = F.when((F.coalesce(F.size("_turns"), F.lit(0)) <= 0) | F.exists("_turns", bad), S.BAD_OPTION)
    checked = checked_options(pages, options.withColumn("_turns", F.transform(entries, turn)), code)
    angles = checked.filter("error_code IS NULL").select("doc_id", F.posexplode("_turns").alias("_at", "_t")).groupBy(
        "doc_id", F.col("_t.page").alias("page_no")).agg(F.max_by("_t.angle", "_at").alias("angle"))
    turned = V.normal_angle(F.col("rotation") + F.coalesce("angle", F.lit(0)))
    return _emit(pages.join(angles, ["doc_id", "page_no"], "left"), checked.select("doc_id", "_last", "error_code"),
                 F.lit(True), {"page_no": F.col("page_no"), "rotation": turned})


def parse_order(order: Column) -> Column:
    """``3,1,2`` as numbers; null when a token is not a number."""
    tokens = F.transform(F.split(order, ","), V.strip)
    numbers = F.transform(tokens, lambda t: t.try_cast("int"))
    return F.when(F.forall(tokens, lambda t: t.rlike(r"\A[+-]?\d+\z")), numbers)


def is_permutation(order: Column, page_count: Column) -> Column:
    return F.coalesce(F.array_sort(order) == F.sequence(F.lit(1), page_count.cast("int")), F.lit(False))


def reorder_pages(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Pages in the order of a permutation of 1..n."""
    code = F.when(V.blank_to_null(F.col("order")).isNull(), S.MISSING_OPTION).when(
        ~is_permutation(F.col("_order"), F.col("page_count")), S.BAD_OPTION)
    checked = checked_options(pages, options.withColumn("_order", parse_order(F.col("order"))), code)
    moved = checked.filter("error_code IS NULL").select("doc_id", F.posexplode("_order").alias("_pos", "page_no"))
    rows = pages.join(moved, ["doc_id", "page_no"]).select(
        "doc_id", F.col("page_no").alias("old_page_no"), (F.col("_pos") + 1).alias("page_no"), "text",
        F.lit(None).cast("string").alias("error_code"))
    none = checked.filter("error_code IS NOT NULL").select("doc_id", "error_code")
    return rows.unionByName(none, allowMissingColumns=True)


def split_pages(pages: DataFrame, options: DataFrame) -> DataFrame:
    """(document, group, output name, page): one group per range token or per page.

    Overlapping ranges put a page in several groups.
    """
    by_range = F.col("mode") == "ranges"
    code = (
        F.when(~F.coalesce(F.col("mode").isin("ranges", "every"), F.lit(False)), S.BAD_OPTION)
        .when(by_range & R.is_blank(F.col("spec")), S.MISSING_OPTION)
        .when(by_range, R.spec_code(F.col("spec"), F.col("page_count"), code=S.BAD_OPTION))
    )
    numbered = F.when(by_range, F.transform(R.intervals(F.col("spec")), lambda iv, i: F.struct(
        i.cast("long").alias("group_no"), iv["start"].alias("first"), iv["end"].alias("last"))))
    checked = checked_options(pages, options, code, _groups=numbered)
    mine = F.filter("_groups", lambda g: F.col("page_no").between(g["first"], g["last"]))
    single = F.array(F.struct((F.col("page_no") - 1).cast("long").alias("group_no"), F.col("page_no").cast("long").alias("first"),
                              F.col("page_no").cast("long").alias("last")))
    placed = beside_pages(pages, checked.filter("error_code IS NULL").select("doc_id", "_last", "_groups"))
    rows = placed.select("doc_id", F.explode(F.when(F.col("_groups").isNull(), single).otherwise(mine)).alias("_g"),
                         "page_no").select(
        "doc_id", F.col("_g.group_no").alias("group_no"), V.split_name(F.col("_g.first"), F.col("_g.last")).alias("out_name"),
        "page_no", F.lit(None).cast("string").alias("error_code"))
    bad = checked.filter("error_code IS NOT NULL").select("doc_id", "error_code")
    return rows.unionByName(bad, allowMissingColumns=True)


def split_outputs(split: DataFrame) -> DataFrame:
    """One row per split output."""
    return split.filter("error_code IS NULL").groupBy("doc_id", "group_no", "out_name").agg(
        F.count(F.lit(1)).alias("pages"))


def write_groups(split: DataFrame, pages: DataFrame, path: str, folder_per_group: bool = False) -> None:
    """The pages of all split outputs: by default as rows (few large files); on demand one folder
    per output, each written by one task."""
    body = split.filter("error_code IS NULL").join(pages, ["doc_id", "page_no"]).select(
        "doc_id", "out_name", "page_no", "text")
    if folder_per_group:
        body.repartition("doc_id", "out_name").write.mode("overwrite").partitionBy("doc_id", "out_name").parquet(path)
    else:
        body.write.mode("overwrite").parquet(path)


def label_pages(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Stamp ``prefix + number + suffix`` on the selected pages; others stay unlabelled."""
    start, start_code = V.int_option(F.col("start_number"), 1)
    code = F.coalesce(start_code, R.spec_code(F.col("spec"), F.col("page_count"), blank_ok=True))
    checked = checked_options(pages, options, code, _iv=R.parsed(F.col("spec")), _start=start)
    number = F.col("_start") + R.pages_before(F.col("_iv"), F.col("page_no"))
    label = F.when(
        R.contains_page(F.col("_iv"), F.col("page_no"), blank_means_all=True),
        F.concat(F.coalesce("prefix", F.lit("")), number.cast("string"), F.coalesce("suffix", F.lit(""))),
    )
    return _emit(pages, checked, F.lit(True), {"page_no": F.col("page_no"), "label": label})


# -------------------------------------------------------------------- merge

def _document_offsets(pages: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Pages before each document and its 0-based place, per output.

    Sums run over documents (not pages) and are cut at 65,536 sequence numbers, so
    even one output of all documents is no single task.
    """
    sized = document_options(pages, members)
    piece = F.floor(F.col("doc_seq") / 65536)
    both = F.struct(F.col("page_count").alias("pages"), F.lit(1).cast("long").alias("documents"))
    return running_totals(sized, keys, piece, [F.col("doc_seq")], both, {"pages": "pages_before", "documents": "place"})


def _without_pages(offsets: DataFrame) -> DataFrame:
    return offsets.filter("page_count = 0").select("out_id", "doc_id", F.lit(S.MISSING_INPUT).alias("error_code"))


def merge_documents(pages: DataFrame, members: DataFrame) -> DataFrame:
    """Documents of one output in input order. ``members(out_id, doc_id, doc_seq)``. A member
    without pages yields one row with its code."""
    offsets = _document_offsets(pages, members, ["out_id"])
    df = beside_pages(pages, offsets.filter("page_count > 0"))
    rows = df.select("out_id", (F.col("pages_before") + F.col("page_no")).alias("out_page_no"),
                     "doc_seq", "doc_id", "page_no", "text", F.lit(None).cast("string").alias("error_code"))
    return rows.unionByName(_without_pages(offsets), allowMissingColumns=True)


def merge_by_order(pages: DataFrame, members: DataFrame, orders: DataFrame) -> DataFrame:
    """Merge by an explicit JSON list of [file, page]; pages may repeat or be left out.

    ``orders(out_id, page_order)``; file numbers are 0-based ``doc_seq`` values.
    """
    refs = F.from_json("page_order", "array<array<int>>")
    listed = orders.withColumn("_refs", refs).select("out_id", F.posexplode_outer("_refs").alias("pos", "_ref"))
    rows = listed.select("out_id", "pos", F.size("_ref").alias("_n"),
                         F.get("_ref", F.lit(0)).alias("doc_seq"), F.get("_ref", F.lit(1)).alias("page_no"))
    sized = page_counts(pages).join(members, "doc_id").select("out_id", "doc_seq", "doc_id", "page_count")
    found = rows.join(sized, ["out_id", "doc_seq"], "left")
    fine = F.coalesce((F.col("_n") == 2) & F.col("page_no").between(1, F.col("page_count")), F.lit(False))
    bad = found.filter(~fine).select("out_id").distinct().withColumn("error_code", F.lit(S.BAD_OPTION))
    good = found.join(bad, "out_id", "left_anti").select("out_id", "pos", "doc_seq", "doc_id", "page_no")
    out = good.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"]).select(
        "out_id", (F.col("pos") + 1).alias("out_page_no"), "doc_seq", "page_no", "text",
        F.lit(None).cast("string").alias("error_code"))
    return out.unionByName(bad, allowMissingColumns=True)


def is_natural_order(refs: DataFrame, natural: DataFrame) -> DataFrame:
    """Whether ``refs(out_id, pos, doc_seq, page_no)`` lists every page in natural order."""
    a = refs.select("out_id", "pos", "doc_seq", "page_no", F.lit(True).alias("_a"))
    b = natural.select("out_id", "pos", F.col("doc_seq").alias("_seq"), F.col("page_no").alias("_page"))
    same = (F.col("doc_seq").eqNullSafe(F.col("_seq")) & F.col("page_no").eqNullSafe(F.col("_page")))
    return a.join(b, ["out_id", "pos"], "full_outer").groupBy("out_id").agg(F.bool_and(same).alias("is_identity"))


def combine_exhibits(pages: DataFrame, members: DataFrame, exhibit_prefix: str = "Exhibit",
                     bates_prefix: str = "BATES", bates_start: int = 1, slip_sheets: bool = True) -> DataFrame:
    """Stamp one running number over all pages of an output and put a slip sheet
    (page 0) before each document. ``members(out_id, doc_id, doc_seq, filename)``. A member without
    pages keeps its place and letter and yields one row with its code.

    Numbers are offset plus page number, so the pages are never sorted globally.
    """
    offsets = _document_offsets(pages, members, ["out_id"])
    slips_before = F.col("place") + 1 if slip_sheets else F.lit(0)
    none = F.lit(None).cast("string").alias("error_code")
    stamped = beside_pages(pages, offsets.filter("page_count > 0")).select(
        "out_id", (F.col("pages_before") + F.col("page_no") + slips_before).alias("sheet_no"), "doc_id", "page_no",
        V.bates_label(bates_prefix, F.col("pages_before") + F.col("page_no") + (bates_start - 1)).alias("stamp"), none)
    out = stamped.unionByName(_without_pages(offsets), allowMissingColumns=True)
    if not slip_sheets:
        return out
    slips = offsets.select(
        "out_id", (F.col("pages_before") + F.col("place") + 1).alias("sheet_no"), "doc_id",
        F.lit(0).cast("long").alias("page_no"),
        F.concat_ws(" | ", F.concat_ws(" ", F.lit(exhibit_prefix), V.exhibit_letter(F.col("place"))), "filename",
                    F.concat(F.col("page_count").cast("string"), F.lit(" page(s)"))).alias("stamp"), none)
    return out.unionByName(slips)


# ------------------------------------------------------------------ layouts

def grid(layout: int, landscape: bool) -> tuple[int, int]:
    """(columns, rows) of an n-up sheet."""
    tall = {2: (1, 2), 4: (2, 2), 6: (2, 3), 9: (3, 3)}[layout]
    return tall[::-1] if landscape else tall


def n_up(pages: DataFrame, layout: int, landscape: bool = False) -> DataFrame:
    """Sheet, column and row of each page; by arithmetic, without a shuffle."""
    columns, _ = grid(layout, landscape)
    cell = (F.col("page_no") - 1) % layout
    return pages.select(
        "doc_id", "page_no", (F.floor((F.col("page_no") - 1) / layout) + 1).alias("sheet_no"),
        (cell % columns).alias("col"), F.floor(cell / columns).alias("row"))


def page_runs(pages: DataFrame) -> DataFrame:
    """Contiguous runs [first, last] of the distinct page numbers of each document."""
    distinct = pages.select("doc_id", "page_no").distinct()
    numbered = number_rows(distinct, ["doc_id"], "page_no", "_n")
    return numbered.groupBy("doc_id", (F.col("page_no") - F.col("_n")).alias("_run")).agg(
        F.min("page_no").alias("first"), F.max("page_no").alias("last")).drop("_run")


def compact_ranges(pages: DataFrame) -> DataFrame:
    """Page rows back to a spec such as ``1-3,5``."""
    token = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat_ws("-", "first", "last"))
    runs = page_runs(pages).select("doc_id", F.struct("first", token.alias("token")).alias("_t"))
    return runs.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t["token"]), ",").alias("spec"))


def group_by_dividers(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Group number of each page when splitting after the given ``dividers`` (array).

    Out-of-range dividers are ignored and repeats dropped.
    """
    df = with_document_options(pages, options)
    cuts = F.array_distinct(F.filter("dividers", lambda d: d.between(1, F.col("page_count") - 1)))
    return df.select("doc_id", "page_no", F.size(F.filter(cuts, lambda d: d < F.col("page_no"))).alias("group_no"))


def divider_groups(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("doc_id", "group_no").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last"))


def append_new(items: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows plus the incoming ones whose key is unknown."""
    return items.unionByName(incoming.join(items.select(*key).distinct(), key, "left_anti"))


def compare_documents(left: DataFrame, right: DataFrame) -> DataFrame:
    """Page-by-page comparison of paired documents ``(pair_id, page_no, text)``."""
    a = left.select("pair_id", "page_no", F.col("text").alias("_a"), F.lit(True).alias("_la"))
    b = right.select("pair_id", "page_no", F.col("text").alias("_b"), F.lit(True).alias("_lb"))
    state = (
        F.when(F.col("_la").isNull(), "added").when(F.col("_lb").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    )
    return a.join(b, ["pair_id", "page_no"], "full_outer").select("pair_id", "page_no", state.alias("state"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Counts per pair; a pair without any difference gets ``no_differences``."""
    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state).alias(state)

    summed = compared.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("pages"), *[n(s) for s in ("unchanged", "changed", "added", "removed")])
    return summed.withColumn("error_code", F.when(F.col("pages") == F.col("unchanged"), S.NO_DIFFERENCES))
