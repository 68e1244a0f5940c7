"""Rates, intervals and folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null, never 0, over nothing."""
    return part / F.when(whole != 0, whole)


def wilson(hits: Column, of: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % score interval; null over nothing."""
    n = F.when(of != 0, of).cast("double")
    p = hits / n
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    low = F.when(n.isNotNull(), F.greatest(centre - half, F.lit(0.0)))
    return low, F.when(n.isNotNull(), F.least(centre + half, F.lit(1.0)))


def fold(group: Column, folds: int = 5) -> Column:
    """The first four bytes of the group's SHA-256 as a number, modulo the folds."""
    return F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("long") % folds


def share(x: Column) -> Column:
    """Rounded to four decimals, halves up."""
    return F.floor(x * 10000 + 0.5) / 10000
