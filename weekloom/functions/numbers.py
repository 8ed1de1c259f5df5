"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekloom.functions.dates import as_col


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; NULL stays NULL (``greatest`` alone would skip it)."""
    x = as_col(c)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def floor_zero(c: Column | str) -> Column:
    return clip(c, 0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of a division by zero."""
    return top / F.when(bottom != 0, bottom)


def capped_low(lower: Column | str, median: Column | str) -> Column:
    lo, me = as_col(lower), as_col(median)
    return F.when(me - lo > 0, me - (me - lo) * 0.5).otherwise(lo)


def capped_high(median: Column | str, upper: Column | str) -> Column:
    me, hi = as_col(median), as_col(upper)
    return F.when(hi - me > 0, me + (hi - me) * 0.5).otherwise(hi)


def blend(a: Column | str, b: Column | str, weight: Column | float) -> Column:
    """Weighted mean of two forecasts, never below zero. The weights add up to one."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return floor_zero(as_col(a) * w + as_col(b) * (F.lit(1.0) - w))
