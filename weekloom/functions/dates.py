"""Calendar expressions. Everything is date grained and independent of the session time zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_start(c: Column | str) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", as_col(c)).cast("date")


def week_end(c: Column | str) -> Column:
    return F.date_add(week_start(c), 6)


def iso_week(c: Column | str) -> Column:
    return F.weekofyear(as_col(c))


def weeks_between(first: Column | str, c: Column | str) -> Column:
    """Whole 7-day blocks from ``first`` to ``c``."""
    return F.floor(F.datediff(as_col(c), as_col(first)) / 7)


def epoch_date(seconds: Column | str) -> Column:
    """UTC date of an epoch second, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(as_col(seconds) / 86400).cast("int"))


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a zone-less timestamp read as UTC, whatever the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), as_col(ts))


def utc_instant(ts: Column | str) -> Column:
    """A zone-less timestamp as the UTC instant that reads the same."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), as_col(ts)))


def span_text(start: Column | str, end: Column | str) -> Column:
    day = "yyyy-MM-dd"
    return F.concat_ws(" to ", F.date_format(as_col(start), day), F.date_format(as_col(end), day))


def monsoon_of_month(month: Column | str) -> Column:
    """Training rule: December to February NE, March and April IM1, May to September SW, rest IM2."""
    m = as_col(month)
    return (
        F.when(m.isin(12, 1, 2), "NE").when(m.isin(3, 4), "IM1").when(m.between(5, 9), "SW").otherwise("IM2")
    )


def week_angle(week_number: Column | str) -> Column:
    """Angle on a 52-week circle, so ISO week 53 falls on week 1."""
    return as_col(week_number) * F.lit(2.0 * math.pi) / F.lit(52.0)


def forecast_gate(start: Column | str, today: Column, last_actual: Column | str, max_days: int) -> Column:
    """True where a week lies after the last observed one and at most ``max_days`` ahead."""
    ahead = F.greatest(F.datediff(as_col(start), today), F.lit(0))
    return (ahead <= max_days) & (as_col(start) > as_col(last_actual))
