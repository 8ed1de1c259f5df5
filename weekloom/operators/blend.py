"""Blending two forecasts: weight search, closed form, district bias and application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.numbers import blend, clip, floor_zero, ratio
from weekloom.runtime import small_side


def _steps(steps: int) -> list[tuple[int, float]]:
    return [(k, k / steps) for k in range(steps + 1)]


def _long(df: DataFrame, by: Sequence[str], cells: list[Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.inline("cells"))


def weight_errors(df: DataFrame, by: Sequence[str], steps: int = 50, y: str = "target", a: str = "a", b: str = "b") -> DataFrame:
    """MAE of every weight k/steps: one pass with one accumulator per weight, no row is multiplied."""
    cells = [
        F.struct(F.lit(k).alias("step"), F.lit(w).alias("weight"), F.avg(F.abs(F.col(y) - blend(a, b, w))).alias("mae"))
        for k, w in _steps(steps)
    ]
    return _long(df, by, cells)


def best_weight(df: DataFrame, by: Sequence[str], steps: int = 50) -> DataFrame:
    """The weight with the smallest MAE; the smaller weight wins a tie."""
    errors = weight_errors(df, by, steps)
    pick = F.min(F.struct(F.round("mae", 9).alias("mae"), "step", "weight")).alias("p")
    return errors.groupBy(*by).agg(pick).select(*by, "p.step", "p.weight", "p.mae")


def closed_form_weight(df: DataFrame, by: Sequence[str], y: str = "target", a: str = "a", b: str = "b") -> DataFrame:
    """Least-squares weight of ``a`` against ``b``, kept inside [0.01, 0.99]."""
    gap = F.col(a) - F.col(b)
    top, bottom = F.sum((F.col(y) - F.col(b)) * gap), F.sum(gap * gap)
    w = clip(F.coalesce(ratio(top, bottom), F.lit(0.5)), 0.01, 0.99)
    return df.groupBy(*by).agg(w.alias("weight_a")).withColumn("weight_b", F.lit(1.0) - F.col("weight_a"))


def bias_ratio(y: Column, p: Column) -> Column:
    """Actual over forecast; forecasts of at most 0.5 count as unbiased."""
    return F.when(p > 0.5, y / p).otherwise(F.lit(1.0))


def district_bias(df: DataFrame, by: Sequence[str] = ("disease", "district"), y: str = "target", p: str = "p") -> DataFrame:
    """Median ratio per area inside [0.3, 4]. A series holds at most one row per week, so the exact
    built-in percentile of it is small."""
    r = bias_ratio(F.col(y), F.col(p))
    return df.groupBy(*by).agg(clip(F.percentile(r, F.lit(0.5)), 0.3, 4.0).alias("factor"))


def apply_bias(df: DataFrame, factors: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("disease", "district")) -> DataFrame:
    """Scale the forecasts by the area factor (1 where unknown)."""
    df = df.join(small_side(factors), list(keys), "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return df.withColumns({c: F.col(c) * F.col("factor") for c in columns})


def ordered_interval(df: DataFrame, low: str = "lower", mid: str = "median", high: str = "upper") -> DataFrame:
    """Non-negative bounds with low <= mid <= high."""
    df = df.withColumns({c: floor_zero(c) for c in (low, mid, high)})
    return df.withColumns({low: F.least(low, mid), high: F.greatest(high, mid)})


def r2_by_weight(df: DataFrame, by: Sequence[str], area: Sequence[str], steps: int = 6, y: str = "target") -> DataFrame:
    """R2 of every weight with the area bias recomputed for that weight.

    The factors of all weights are one array per area (a series is at most one row per
    week), joined back once; the errors are then one accumulator per weight.
    """
    ps = {k: blend("a", "b", w) for k, w in _steps(steps)}
    keys = [*by, *area]
    medians = [clip(F.percentile(bias_ratio(F.col(y), p), F.lit(0.5)), 0.3, 4.0) for p in ps.values()]
    factors = small_side(df.groupBy(*keys).agg(F.array(*medians).alias("_f")))
    rows = df.join(factors, keys)
    sst = F.count("*") * F.var_pop(y)
    cells = [
        F.struct(
            F.lit(k).alias("step"), F.lit(k / steps).alias("weight"),
            (F.lit(1.0) - ratio(F.sum((F.col(y) - p * F.col("_f")[k]) ** 2), sst)).alias("r2"),
        )
        for k, p in ps.items()
    ]
    return _long(rows, by, cells)
