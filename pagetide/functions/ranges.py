"""Page range specs such as ``1-3,5,8-10``.

A spec is kept as an array of (start, end) intervals. Membership is then a test
over the few intervals of a spec, and no page list is ever materialised unless
the caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# Fixed value: one token of a spec.
TOKEN = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"

# Codes of the browser-side twin of the check.
CLIENT_CODES = ("invalid_page_range", "invalid_range_start", "reversed_range")


def is_blank(spec: Column) -> Column:
    return F.coalesce(spec, F.lit("")).rlike(r"\A\s*\z")


def intervals(spec: Column) -> Column:
    """Array of (start, end), one per token, in order. Unreadable tokens give nulls."""
    def one(token: Column) -> Column:
        start = F.regexp_extract(token, TOKEN, 1).try_cast("long")
        end = F.nullif(F.regexp_extract(token, TOKEN, 2), F.lit(""))
        return F.struct(
            start.alias("start"),
            F.when(end.isNull(), start).otherwise(end.try_cast("long")).alias("end"),
        )

    return F.transform(F.split(spec, ","), one)


def spec_code(spec: Column, page_count: Column | None = None, blank_ok: bool = False,
              code: str = S.INVALID_OPTION, client_codes: bool = False) -> Column:
    """Error code of the first bad token, or null."""
    syntax, low, backwards = CLIENT_CODES if client_codes else (code, code, code)

    def check(iv: Column) -> Column:
        found = (
            F.when(iv["start"].isNull() | iv["end"].isNull(), syntax)
            .when((iv["start"] < 1), low)
            .when(iv["end"] < iv["start"], backwards)
        )
        return found if page_count is None else found.when(iv["end"] > page_count, code)

    problems = F.filter(F.transform(intervals(spec), check), lambda c: c.isNotNull())
    blank = F.lit(None).cast("string") if blank_ok else F.lit(code)
    return F.when(is_blank(spec), blank).otherwise(F.get(problems, F.lit(0)))


def parsed(spec: Column) -> Column:
    """The intervals of a spec, null for a blank one; made once per document and kept as a column."""
    return F.when(~is_blank(spec), intervals(spec))


def contains_page(ivs: Column, page_no: Column, blank_means_all: bool = False) -> Column:
    """Whether the intervals of a valid spec (see ``parsed``) name ``page_no``."""
    hit = F.exists(ivs, lambda iv: page_no.between(iv["start"], iv["end"]))
    return F.coalesce(hit, ivs.isNull() & F.lit(blank_means_all))


def page_list(spec: Column) -> Column:
    """Sorted distinct page numbers of a spec; null when the spec is not valid."""
    listed = F.array_sort(F.array_distinct(F.flatten(
        F.transform(intervals(spec), lambda iv: F.sequence(iv["start"], iv["end"]))
    )))
    return F.when(spec_code(spec).isNull(), listed)


def selected_count(spec: Column) -> Column:
    """How many distinct pages a valid spec names, without listing them.

    Intervals are sorted by start; each adds what lies beyond the furthest page so far.
    """
    state = "struct<far:bigint,total:bigint>"
    folded = F.aggregate(
        F.array_sort(intervals(spec)),
        F.struct(F.lit(0).alias("far"), F.lit(0).alias("total")).cast(state),
        lambda acc, iv: F.struct(
            F.greatest(acc["far"], iv["end"]).alias("far"),
            (acc["total"] + F.greatest(
                F.lit(0), iv["end"] - F.greatest(acc["far"], iv["start"] - 1)
            )).alias("total"),
        ).cast(state),
    )
    return folded["total"]


def pages_before(ivs: Column, page_no: Column) -> Column:
    """How many pages of the intervals (see ``parsed``) lie before ``page_no``: its 0-based rank."""
    state = "struct<far:bigint,total:bigint>"

    def add(acc: Column, iv: Column) -> Column:
        end = F.least(iv["end"], page_no - 1)
        return F.struct(
            F.greatest(acc["far"], end).alias("far"),
            (acc["total"] + F.greatest(
                F.lit(0), end - F.greatest(acc["far"], iv["start"] - 1)
            )).alias("total"),
        ).cast(state)

    folded = F.aggregate(
        F.array_sort(ivs), F.struct(F.lit(0).alias("far"), F.lit(0).alias("total")).cast(state), add)
    return F.when(ivs.isNull(), page_no - 1).otherwise(folded["total"])
