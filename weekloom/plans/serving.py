"""Serving lookups as table functions over stored panels and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.dates import span_text
from weekloom.functions.numbers import blend, capped_high, capped_low, floor_zero
from weekloom.operators import blend as blending
from weekloom.operators import features, joins, weekly
from weekloom.operators.tidy import in_list, in_range


def list_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def past_cases(series: DataFrame, disease: str, districts: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Cases of all splits with pushed-down filters; ``disease`` prunes partitions of a stored series."""
    df = in_range(in_list(series.filter(F.col("disease") == disease), "district", districts), "week_start", first, last)
    return df.select("district", "week_start", F.date_add("week_start", 6).alias("week_end"), F.col("target").alias("cases"))


def cases_in_week(series: DataFrame, week: Column) -> DataFrame:
    return series.filter(F.col("week_start") == week).groupBy("disease").agg(F.sum("target").alias("cases"))


def past_weeks_and_forecast(series: DataFrame, forecasts: DataFrame, week: Column, by: Sequence[str], weeks: int = 4, value: str = "median") -> DataFrame:
    """The weeks before ``week`` as actuals, then the forecast of that week, per group."""
    past = series.filter((F.col("week_start") < week) & (F.col("week_start") >= F.date_sub(week, 7 * weeks)))
    actual = past.groupBy(*by, "week_start").agg(F.sum("target").cast("double").alias("cases")).withColumn("kind", F.lit("actual"))
    ahead = forecasts.filter(F.col("week_start") == week).groupBy(*by, "week_start").agg(F.sum(value).alias("cases"))
    return actual.unionByName(ahead.withColumn("kind", F.lit("predicted")))


def prediction_payload(history: DataFrame, week_rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Features of the prediction week from history plus that week's climate rows.

    A week row replaces a history row of the same key; its target is NULL so no made-up
    zero reaches a later window. Without week rows the newest history week is returned.
    """
    both = history.withColumn("_source", F.lit(0)).unionByName(week_rows.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    rows = joins.keep_last(both, ["disease", "district", "week_start"], "_source")
    built = features.build_features(rows, codes=codes)
    newest = both.agg(F.max(F.struct("_source", "week_start")).getField("week_start")).scalar()
    return built.filter(F.col("week_start") == newest)


def predict_interval(df: DataFrame, factors: DataFrame, weight: float, back: str | None = None) -> DataFrame:
    """Blend of two learners' (lower, median, upper), area bias on all three, then ordered bounds.

    ``back`` names the seasonal mean plus trend of rows whose learners forecast what is left
    above them; it is added to the blend, never below zero, before the bias. NULL adds nothing.
    """
    bounds = ("lower", "median", "upper")
    out = df.withColumns({q: blend(f"a_{q}", f"b_{q}", weight) for q in bounds})
    if back:
        out = out.withColumns({q: floor_zero(F.col(q) + F.coalesce(F.col(back), F.lit(0.0))) for q in bounds})
    return blending.ordered_interval(blending.apply_bias(out, factors, list(bounds)))


def predict_totals(intervals: DataFrame) -> DataFrame:
    """Country sums per disease and week."""
    return intervals.groupBy("disease", "week_start").agg(
        *[F.sum(c).alias(c) for c in ("lower", "median", "upper")], F.count("*").alias("districts"),
    ).withColumn("week_range", span_text("week_start", F.date_add("week_start", 6)))


def planning_total(intervals: DataFrame) -> DataFrame:
    """Sums of the rounded half-gap bounds and of the medians."""
    low, high = capped_low("lower", "median"), capped_high("median", "upper")
    return intervals.groupBy("disease", "week_start").agg(
        F.sum(F.bround(low, 0)).cast("bigint").alias("total_low"), F.sum(F.bround(high, 0)).cast("bigint").alias("total_high"),
        F.sum("median").alias("total_median"))


def feature_importance(table: DataFrame, name: str = "feature", value: str = "value") -> DataFrame:
    """Trimmed names; values that are not numbers become 0."""
    number = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    return table.select(F.trim(name).alias("feature"), F.round(number, 4).alias("importance"))


def weekly_feature_row(readings: DataFrame, first: Column, last: Column, history: DataFrame, lagged: Sequence[str]) -> DataFrame:
    """Weekly aggregates of readings with season columns and the six lag weeks of ``history`` where complete."""
    week = weekly.seasonal_encoding(weekly.readings_in_week(readings, first, last))
    lags = joins.lag_weeks(history.select("district", "week_start", *lagged), lagged, 6, ["district"])
    return (
        week.withColumn("duration", span_text("week_start", F.date_add("week_start", 6)))
        .join(lags, ["district", "week_start"], "left")
    )
