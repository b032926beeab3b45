"""NULL, NaN and rounding rules shared by all operators.

Undefined values are NULL, never zero. NaN compares greater than everything in
Spark, so thresholds go through the ``*_num`` helpers, which are false on NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(value: float) -> Column:
    """A double literal; SQL text such as 0.35 + 0.05 would become a decimal."""
    return F.lit(float(value))


def gt_num(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a > b)


def lt_num(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + dbl(0.5))


def nan_if(poison: Column, x: Column) -> Column:
    return F.when(poison, dbl(float("nan"))).otherwise(x)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))
