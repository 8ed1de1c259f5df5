"""Joins of the panel: all are equi joins on declared keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.dates import as_col
from weekloom.runtime import small_side


def attach_cases(weather: DataFrame, cases: DataFrame, keys: Sequence[str] = ("district", "start_date", "end_date")) -> DataFrame:
    """Weather LEFT JOIN cases; weeks without a report keep NULL counts."""
    return weather.join(cases, list(keys), "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that would fan a join out."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Left join to a lookup (broadcast only after its rows were counted), with default values."""
    joined = df.join(small_side(table), list(keys), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def hierarchical_mean(
    df: DataFrame, train: DataFrame, fine: Sequence[str], coarse: Sequence[str], value: str = "target", out: str = "seasonal_mean",
    by: Sequence[str] = ("disease",),
) -> DataFrame:
    """Train mean of the fine key, else of the coarse key, else the mean of the group's coarse means.

    ``by`` is part of every level, so a group never takes another group's mean; a group without
    train rows gets NULL. All levels are folded from one aggregate of the train rows, whose
    exchange the joins reuse, and sizes decide at run time how each level is joined.
    """
    if not set(by) <= set(fine) & set(coarse) or not set(coarse) <= set(fine):
        raise ValueError("every level must hold the keys of the one below it")
    cells = train.groupBy(*fine).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    f = cells.select(*fine, (F.col("_s") / F.nullif("_n", F.lit(0))).alias("_fine"))
    c = cells.groupBy(*coarse).agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("_coarse"))
    rest = c.groupBy(*by).agg(F.avg("_coarse").alias("_rest"))
    return (
        df.join(f, list(fine), "left").join(c, list(coarse), "left").join(rest, list(by), "left")
        .withColumn(out, F.coalesce("_fine", "_coarse", "_rest")).drop("_fine", "_coarse", "_rest")
    )


def lag_weeks(df: DataFrame, columns: Sequence[str], depth: int, by: Sequence[str], week: str = "week_start") -> DataFrame:
    """The ``depth`` calendar weeks before each row, newest first, only where all of them exist.

    Weeks are unique per key, so the ``depth``-th row back lies exactly ``depth`` weeks back only
    if no week between is missing: one window and one shuffle instead of a self join per lag.
    """
    w = Window.partitionBy(*by).orderBy(week)
    lags = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in range(1, depth + 1)}
    rows = df.select(*by, week, *columns).withColumns({**lags, "_oldest": F.lag(week, depth).over(w)})
    return rows.filter(F.col("_oldest") == F.date_sub(F.col(week), 7 * depth)).select(*by, week, *lags)


def present_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def in_every_week(df: DataFrame, weeks: int, area: str = "district", week: str = "week_start") -> DataFrame:
    """Areas seen in ``weeks`` distinct weeks."""
    return df.groupBy(area).agg(F.countDistinct(week).alias("weeks")).filter(F.col("weeks") == weeks)


def missing_keys(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).join(present.select(*keys), list(keys), "left_anti")


def split_overlap(df: DataFrame, keys: Sequence[str], left: str, right: str, split: str = "split") -> DataFrame:
    """Number of keys found in both splits, from one aggregate per key."""
    has = lambda s: F.max(F.when(F.col(split) == s, 1).otherwise(0))
    both = df.groupBy(*keys).agg((has(left) + has(right)).alias("_h")).filter("_h = 2")
    return both.agg(F.count("*").alias("overlap"))


def keep_last(df: DataFrame, keys: Sequence[str], rank: Column | str) -> DataFrame:
    """One row per key, the highest ``rank`` winning; a mergeable aggregate instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), as_col(rank)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


