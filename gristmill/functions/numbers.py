"""Percentages and roundings as reports show them.  Halves go to the even neighbour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_pct(count: Column, total: Column, decimals: int = 1, most: int = 12) -> Column:
    """Percent with ``decimals`` places, or as many more (up to ``most``) as a first digit other than zero needs."""
    pct = count.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * 100
    steps = [F.nullif(F.bround(pct, d), F.lit(0.0)) for d in range(decimals, most)]
    return F.when((count == 0) | count.isNull() | total.isNull() | (total == 0), 0.0).otherwise(F.coalesce(*steps, F.bround(pct, most)))


def split_pct(part: Column, other: Column) -> Column:
    """Whole percent of ``part`` in both; 100 without either."""
    both = part + other
    return F.when(both > 0, F.bround(part * 100.0 / both, 0).cast("int")).otherwise(100)


def safe_int(c: Column) -> Column:
    """The whole number that a value is or is cut to, else null."""
    return c.try_cast("int")


def significant(c: Column, digits: int = 2) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when(c == 0, 0.0).otherwise(F.bround(c / scale, 0) * scale)
