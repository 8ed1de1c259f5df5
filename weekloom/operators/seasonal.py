"""Seasonal baseline, linear trend and the normalisation built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.numbers import floor_zero
from weekloom.operators.joins import hierarchical_mean
from weekloom.runtime import small_side

FINE = ("disease", "district", "week_number")
COARSE = ("disease", "week_number")


def seasonal_baseline(train: DataFrame, value: str = "target") -> DataFrame:
    """Means by (district, week), by week, overall and of the week means, as one keyed table.

    All levels are folded from one aggregate of sums and counts, so the rows are read once.
    """
    cells = train.groupBy(*FINE).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    mean = (F.sum("s") / F.sum("n")).alias("mean")
    none = lambda t: F.lit(None).cast(t)
    fine = cells.select(F.lit("district_week").alias("level"), *FINE, (F.col("s") / F.col("n")).alias("mean"))
    weeks = cells.groupBy(*COARSE).agg(mean)
    week = weeks.select(F.lit("week").alias("level"), "disease", none("string").alias("district"), "week_number", "mean")
    total = cells.groupBy("disease").agg(mean).select(
        F.lit("global").alias("level"), "disease", none("string").alias("district"), none("int").alias("week_number"), "mean")
    back = weeks.groupBy("disease").agg(F.avg("mean").alias("mean")).select(
        F.lit("fallback").alias("level"), "disease", none("string").alias("district"), none("int").alias("week_number"), "mean")
    return fine.unionByName(week).unionByName(total).unionByName(back)


def late_mean(train: DataFrame, weeks: int = 52, by: Sequence[str] = ("disease", "district")) -> DataFrame:
    """Mean over the last train weeks of the panel."""
    last = train.agg(F.max("week_index")).scalar()
    return train.filter(F.col("week_index") >= last - weeks).groupBy(*by).agg(F.avg("target").alias("late_mean"))


def with_seasonal_mean(df: DataFrame) -> DataFrame:
    return hierarchical_mean(df, df.filter("split = 'train'"), FINE, COARSE)


def linear_trend(train: DataFrame, value: str = "residual", by: Sequence[str] = ("disease",)) -> DataFrame:
    """Least squares line of the residual over the week index."""
    return train.groupBy(*by).agg(
        F.regr_slope(value, "week_index").alias("slope"), F.regr_intercept(value, "week_index").alias("intercept"))


def seasonal_normalise(df: DataFrame) -> DataFrame:
    """target minus seasonal mean minus trend, every statistic taken from train rows."""
    rows = with_seasonal_mean(df).withColumn("residual", F.col("target") - F.col("seasonal_mean"))
    line = linear_trend(rows.filter("split = 'train'"))
    return (
        rows.join(small_side(line), "disease")
        .withColumn("trend", F.col("intercept") + F.col("slope") * F.col("week_index"))
        .withColumn("normalised", F.col("residual") - F.col("trend"))
        .drop("slope", "intercept")
    )


def add_back(df: DataFrame, value: str = "normalised", out: str = "restored") -> DataFrame:
    """Inverse of ``seasonal_normalise``, never below zero."""
    return df.withColumn(out, floor_zero(F.col(value) + F.col("trend") + F.col("seasonal_mean")))
