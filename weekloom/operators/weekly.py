"""Roll-ups from readings to weeks, and the week calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.constants import CLIMATE_VARIABLES, DISEASES
from weekloom.functions.dates import iso_week, monsoon_of_month, span_text, week_angle, week_start, weeks_between


def climate_aggregates(variables: Sequence[str] = CLIMATE_VARIABLES) -> list[Column]:
    """max / min / avg of every climate variable: all mergeable, so they combine before the shuffle."""
    out = []
    for v in variables:
        out += [F.max(v).alias(f"{v}_max"), F.min(v).alias(f"{v}_min"), F.avg(v).alias(f"{v}_avg")]
    return out


def weekly_climate(readings: DataFrame, day: str = "d", area: str = "district") -> DataFrame:
    """One row per area and Monday week."""
    return readings.groupBy(area, week_start(day).alias("week_start")).agg(*climate_aggregates())


def block_week(readings: DataFrame, day: str = "d", area: str = "district") -> DataFrame:
    """7-day blocks counted from each area's first date.

    The first dates come from a mergeable aggregate joined back, not from a window,
    so an area holding most of the readings never sits in one task.
    """
    from weekloom.runtime import small_side

    first = readings.groupBy(area).agg(F.min(day).alias("first_day"))
    return (
        readings.join(small_side(first), area)
        .withColumn("block_week_id", weeks_between("first_day", day))
        .drop("first_day")
    )


def block_weekly_climate(readings: DataFrame, day: str = "d", area: str = "district") -> DataFrame:
    """Block weeks rolled up, with the observed first and last day and the duration text."""
    return (
        block_week(readings, day, area)
        .groupBy(area, "block_week_id")
        .agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), *climate_aggregates())
        .withColumn("duration", span_text("start_date", "end_date"))
    )


def readings_in_week(readings: DataFrame, first: Column, last: Column, ts: str = "ts", area: str = "district") -> DataFrame:
    """Weekly outputs of sub-daily readings between two dates, both included."""
    day = F.col(ts).cast("date")
    kept = readings.filter((day >= first) & (day <= last))
    return kept.groupBy(area, week_start(ts).alias("week_start")).agg(*climate_aggregates())


def week_calendar(areas: DataFrame, bounds: DataFrame, day: str, area: str = "district") -> DataFrame:
    """Every (area, Monday) between the first and last day of ``bounds``, by exploding a date sequence."""
    span = bounds.agg(
        F.struct(F.min(week_start(day)).alias("lo"), F.max(week_start(day)).alias("hi")).alias("s")
    ).scalar()
    weeks = F.sequence(span.getField("lo"), span.getField("hi"), F.expr("interval 7 days"))
    return areas.select(area, F.explode(weeks).alias("week_start"), span.getField("lo").alias("first_week"))


def count_weekly(cases: DataFrame, day: str = "d", area: str = "district", kind: str = "disease") -> DataFrame:
    """Long case counts: one row per observed (area, week, kind)."""
    return cases.groupBy(area, week_start(day).alias("week_start"), kind).agg(F.count("*").alias("target"))


def count_weekly_wide(
    cases: DataFrame, kinds: Sequence[str] = DISEASES, day: str = "d", area: str = "district", kind: str = "disease"
) -> DataFrame:
    """One row per (area, week) with a nullable count per kind, in a single aggregate (no pivot pass)."""
    ones = [F.sum(F.when(F.col(kind) == k, F.lit(1).cast("bigint"))).alias(k) for k in kinds]
    return cases.groupBy(area, week_start(day).alias("week_start")).agg(*ones)


def seasonal_encoding(df: DataFrame, start: str = "week_start") -> DataFrame:
    """Month, monsoon flags (IM1 is the base level), ISO week and its circle coordinates."""
    month, week = F.month(start), iso_week(start)
    season = monsoon_of_month(month)
    return df.withColumns(
        {
            "month": month,
            "monsoon_IM2": season == "IM2",
            "monsoon_NE": season == "NE",
            "monsoon_SW": season == "SW",
            "week_number": week,
            "sin_week": F.sin(week_angle(week)),
            "cos_week": F.cos(week_angle(week)),
        }
    )


def melt_diseases(wide: DataFrame, ids: Sequence[str], kinds: Sequence[str] = DISEASES) -> DataFrame:
    """Wide count columns to one row per disease: replaces a loop over diseases."""
    return wide.unpivot(list(ids), list(kinds), "disease", "target")
