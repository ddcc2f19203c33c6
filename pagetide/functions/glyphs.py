"""Advance widths of glyphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advance widths (fraction of the font size) of the characters 32 to 126.
WIDTHS = (
    0.278, 0.278, 0.355, 0.556, 0.556, 0.889, 0.667, 0.191, 0.333, 0.333, 0.389, 0.584, 0.278, 0.333, 0.278, 0.278,
    0.556, 0.556, 0.556, 0.556, 0.556, 0.556, 0.556, 0.556, 0.556, 0.556, 0.278, 0.278, 0.584, 0.584, 0.584, 0.556,
    0.833, 0.667, 0.667, 0.722, 0.722, 0.667, 0.611, 0.778, 0.722, 0.278, 0.500, 0.667, 0.556, 0.833, 0.722, 0.778,
    0.667, 0.778, 0.722, 0.667, 0.611, 0.722, 0.667, 0.944, 0.667, 0.667, 0.611, 0.278, 0.45, 0.278, 0.469, 0.556,
    0.278, 0.556, 0.556, 0.500, 0.556, 0.556, 0.333, 0.556, 0.556, 0.222, 0.222, 0.500, 0.222, 0.833, 0.556, 0.556,
    0.556, 0.556, 0.333, 0.500, 0.278, 0.556, 0.500, 0.944, 0.500, 0.500, 0.500, 0.334, 0.260, 0.334, 0.584,
)
# Widths of other digits, capitals, small letters, and the rest.
OTHER_DIGIT, OTHER_UPPER, OTHER_LOWER, OTHER = 0.556, 0.70, 0.50, 0.45


def table_width(ch: Column) -> Column:
    """Typical advance of a character: an array look-up by code point."""
    listed = F.get(F.array(*[F.lit(w) for w in WIDTHS]), F.ascii(ch) - 32)
    other = (
        F.when(ch.rlike(r"\p{Nd}"), F.lit(OTHER_DIGIT)).when(ch.rlike(r"\p{Lu}"), F.lit(OTHER_UPPER))
        .when(ch.rlike(r"\p{Ll}"), F.lit(OTHER_LOWER)).otherwise(F.lit(OTHER))
    )
    return F.when(F.ascii(ch).between(32, 126), listed).otherwise(other)
