"""Joins and running values that hold up when one key owns most rows.

A document, address or session may hold a third of a table. The helpers here cut
such a group by its own ordering column (page number, minute, ...), work inside
the pieces, and carry only one small row per piece across them. The result is
the same as the plain window or join; no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Most rows of one document that may meet in one task.
PAGES_PER_PIECE = 262_144


def piece_of(position: Column, size: int = PAGES_PER_PIECE) -> Column:
    """Piece number of a 1-based position."""
    return F.floor((position - 1) / F.lit(size)).cast("long")


def minute(ts: Column) -> Column:
    """Piece of a time-ordered group: narrow enough to spread one busy key."""
    return F.date_trunc("minute", ts)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"),
                                       F.max("page_no").cast("long").alias("_last"))


def beside_pages(pages: DataFrame, per_doc: DataFrame, size: int = PAGES_PER_PIECE) -> DataFrame:
    """Join one-row-per-document columns (with ``_last``, the highest page) to pages.

    ``per_doc`` is repeated once per piece of the document, so the join key is (document, piece)
    and a huge document spreads over many tasks. Where the side turns out small, adaptive
    execution sends it round instead.
    """
    pieces = per_doc.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), piece_of(F.col("_last"), size)))
    ).drop("_last")
    return pages.withColumn("_piece", piece_of(F.col("page_no"), size)).join(
        pieces, ["doc_id", "_piece"]
    ).drop("_piece")


def document_options(pages: DataFrame, options: DataFrame) -> DataFrame:
    """``options`` (one row per document) with ``page_count`` and ``_last``; a document without
    pages has none (0)."""
    return options.join(page_counts(pages), "doc_id", "left").withColumns({
        c: F.coalesce(c, F.lit(0).cast("long")) for c in ("page_count", "_last")})


def with_document_options(pages: DataFrame, options: DataFrame, size: int = PAGES_PER_PIECE) -> DataFrame:
    """Pages of the documents in ``options``, with ``page_count`` and the option columns."""
    return beside_pages(pages, document_options(pages, options).filter("_last > 0"), size)


def _cut(df: DataFrame, keys: list[str], piece: Column) -> DataFrame:
    """Add the group key as one struct and the piece. A struct of nulls equals itself, so
    the same plain key serves the join and the window, and one shuffle serves both."""
    return df.withColumns({"_cut_key": F.struct(*keys), "_cut_piece": piece})


_PIECE = ["_cut_key", "_cut_piece"]


def running_totals(df: DataFrame, keys: list[str], piece: Column, order: list[Column], values: Column,
                   names: dict[str, str], include_self: bool = False) -> DataFrame:
    """Running sums of the fields of the struct ``values`` over ``keys`` by ``order``, cut at
    ``piece``; ``names`` maps fields to new columns.

    ``piece`` must be non-decreasing along ``order``. Sums per piece are aggregated
    map-side first; the window over them sees one row per (key, piece).
    """
    cut = _cut(df, keys, piece).withColumn("_cut_values", values)
    earlier = Window.partitionBy("_cut_key").orderBy("_cut_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*_PIECE).agg(*[F.sum(f"_cut_values.{f}").alias(f"_cut_sum_{f}") for f in names]).select(
        *_PIECE, *[F.coalesce(F.sum(f"_cut_sum_{f}").over(earlier), F.lit(0)).alias(f"_cut_before_{f}") for f in names])
    inner = Window.partitionBy(*_PIECE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if include_self else -1)
    inside = cut.withColumns({f"_cut_inside_{f}": F.coalesce(F.sum(f"_cut_values.{f}").over(inner), F.lit(0)) for f in names})
    return inside.join(before, _PIECE).withColumns(
        {n: F.col(f"_cut_inside_{f}") + F.col(f"_cut_before_{f}") for f, n in names.items()}).drop(
        *_PIECE, "_cut_values", *[f"_cut_{k}_{f}" for k in ("inside", "before") for f in names])


def running_total(df: DataFrame, keys: list[str], piece: Column, order: list[Column], value: Column,
                  name: str, include_self: bool = True) -> DataFrame:
    """One running sum; see ``running_totals``."""
    return running_totals(df, keys, piece, order, F.struct(value.alias("v")), {"v": name}, include_self)


def number_rows(df: DataFrame, keys: list[str], position: str, name: str,
                size: int = PAGES_PER_PIECE) -> DataFrame:
    """1-based dense numbering over ``keys`` by a numeric, unique ``position``."""
    return running_total(df, keys, piece_of(F.col(position), size), [F.col(position)],
                         F.lit(1), name).withColumn(name, F.col(name).cast("long"))


def previous_value(df: DataFrame, keys: list[str], piece: Column, order: list[Column],
                   value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` strictly before each row, across pieces.

    Inside a piece it is a window; the value carried into a piece is the last one
    of the nearest earlier piece that has any.
    """
    cut = _cut(df, keys, piece).withColumn("_cut_value", value)
    order_key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    earlier = Window.partitionBy("_cut_key").orderBy("_cut_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*_PIECE).agg(
        F.max_by("_cut_value", F.when(F.col("_cut_value").isNotNull(), order_key)).alias("_cut_last")
    ).select(*_PIECE, F.last("_cut_last", ignorenulls=True).over(earlier).alias("_cut_carry"))
    inner = Window.partitionBy(*_PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_cut_inside", F.last("_cut_value", ignorenulls=True).over(inner))
    return inside.join(carried, _PIECE).withColumn(name, F.coalesce("_cut_inside", "_cut_carry")).drop(
        *_PIECE, "_cut_value", "_cut_inside", "_cut_carry")


# Most salts of a look-up.
SALTS = 64


def salted_lookup(facts: DataFrame, dim: DataFrame, keys: list[str], spread_by: list[str],
                  how: str = "left") -> DataFrame:
    """Equi join to a dimension whose keys may be hot on the fact side.

    The dimension is repeated for each of as many salts as the shuffle is wide (at most SALTS),
    over which the facts of one key are spread. Where it turns out small, adaptive execution
    sends it round instead.
    """
    salts = min(SALTS, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return facts.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
