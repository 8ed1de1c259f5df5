"""Lag, rolling, trend, seasonal and interaction features of a weekly panel.

Windows are keyed by (disease, district) and ordered by week. A panel has one row
per (disease, district, week), so such a group never holds more rows than the
calendar has weeks; the raw readings behind it were pre-aggregated before.
All features share one hash exchange: a window keyed by more columns, such as
(disease, district, week_number), is satisfied by the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.constants import LAGGED_CLIMATE, ROLLING_WINDOWS, TARGET_LAGS
from weekloom.functions.dates import as_col
from weekloom.operators.rank import order_codes

SERIES = ("disease", "district")


def series_window(by: Sequence[str] = SERIES, order: str = "week_start"):
    return Window.partitionBy(*by).orderBy(order)


def with_lags(
    df: DataFrame, columns: dict[str, str], lags: Sequence[int], by: Sequence[str] = SERIES, order: str = "week_start"
) -> DataFrame:
    """``{column: prefix}`` lagged by each offset inside its series."""
    w = series_window(by, order)
    return df.withColumns({f"{p}_lag_{k}": F.lag(c, k).over(w) for c, p in columns.items() for k in lags})


def climate_lags(df: DataFrame, by: Sequence[str] = SERIES, order: str = "week_start", depth: int = 6) -> DataFrame:
    return with_lags(df, {c: c for c in LAGGED_CLIMATE}, range(1, depth + 1), by, order)


def target_lags(
    df: DataFrame, lags: Sequence[int] = TARGET_LAGS, by: Sequence[str] = SERIES, order: str = "week_start"
) -> DataFrame:
    return with_lags(df, {"target": "target"}, lags, by, order)


def target_rolling(
    df: DataFrame, windows: Sequence[int] = ROLLING_WINDOWS, by: Sequence[str] = SERIES, order: str = "week_start"
) -> DataFrame:
    """mean, std, max and min over the previous ``w`` rows; the current row is never inside."""
    out = {}
    for n in windows:
        f = series_window(by, order).rowsBetween(-n, -1)
        out[f"target_roll_mean_{n}"] = F.avg("target").over(f)
        out[f"target_roll_std_{n}"] = F.stddev_samp("target").over(f)
        out[f"target_roll_max_{n}"] = F.max("target").over(f)
        out[f"target_roll_min_{n}"] = F.min("target").over(f)
    return df.withColumns(out)


def strict_rolling(
    df: DataFrame, n: int = 4, by: Sequence[str] = SERIES, order: str = "week_start"
) -> DataFrame:
    """mean and std over the previous ``n`` rows, NULL unless all ``n`` are observed."""
    f = series_window(by, order).rowsBetween(-n, -1)
    full = F.count("target").over(f) == n
    return df.withColumns(
        {
            f"strict_mean_{n}": F.when(full, F.avg("target").over(f)),
            f"strict_std_{n}": F.when(full, F.stddev_samp("target").over(f)),
        }
    )


def difference(c: str, by: Sequence[str] = SERIES, order: str = "week_start") -> Column:
    return F.col(c) - F.lag(c, 1).over(series_window(by, order))


def target_trend(df: DataFrame, by: Sequence[str] = SERIES, order: str = "week_start") -> DataFrame:
    """First differences of the 4- and 8-week rolling means, then the change of the former."""
    df = df.withColumns({f"target_trend_{n}": difference(f"target_roll_mean_{n}", by, order) for n in (4, 8)})
    return df.withColumn("target_accel", difference("target_trend_4", by, order))


def climate_interactions(df: DataFrame) -> DataFrame:
    """Products, the temperature range and lagged rain sums over whichever lag columns exist."""
    c = F.col
    rain = lambda depth: sum(
        (F.coalesce(c(f"PRECTOTCORR_avg_lag_{k}"), F.lit(0.0)) for k in range(1, depth + 1)
         if f"PRECTOTCORR_avg_lag_{k}" in df.columns),
        F.lit(0.0),
    )
    return df.withColumns(
        {
            "heat_humidity": c("T2M_avg") * c("RH2M_avg"),
            "rain_humidity": c("PRECTOTCORR_avg") * c("RH2M_avg"),
            "rain_temp": c("PRECTOTCORR_avg") * c("T2M_avg"),
            "temp_range": c("T2M_max") - c("T2M_min"),
            "rain_hum_lag1": c("PRECTOTCORR_avg_lag_1") * c("RH2M_avg_lag_1"),
            "rain_hum_lag2": c("PRECTOTCORR_avg_lag_2") * c("RH2M_avg_lag_2"),
            "cum_rain_4w": rain(4),
            "cum_rain_8w": rain(8),
        }
    )


def train_statistics(
    df: DataFrame,
    by: Sequence[str] = SERIES,
    late_weeks: int = 52,
    week_index: str = "week_index",
    season: str = "week_number",
) -> DataFrame:
    """Train-only means attached to every row as windows over the series partitioning (no join).

    ``late_dist_mean`` covers the last ``late_weeks`` train weeks of the whole
    panel; the last train week arrives as a scalar subquery.
    """
    train = F.col("split") == "train"
    last = df.filter(train).agg(F.max(week_index)).scalar()
    whole = Window.partitionBy(*by)
    seasonal = Window.partitionBy(*by, season)
    y = F.when(train, F.col("target"))
    late = train & (F.col(week_index) >= last - late_weeks)
    df = df.withColumns(
        {"dist_mean": F.avg(y).over(whole), "late_dist_mean": F.avg(F.when(late, F.col("target"))).over(whole)}
    )
    df = df.withColumn("district_week_mean", F.avg(y).over(seasonal))
    return df.withColumns(
        {
            "district_week_mean": F.coalesce("district_week_mean", "dist_mean"),
            "late_dist_mean": F.coalesce("late_dist_mean", "dist_mean"),
        }
    )


def seasonal_ratio(df: DataFrame) -> DataFrame:
    """Recent level against the seasonal mean, as a gap and as a damped ratio."""
    roll, base = F.col("target_roll_mean_4"), F.col("district_week_mean")
    return df.withColumns(
        {"excess_over_seasonal": roll - base, "ratio_to_seasonal": roll / (base + F.lit(0.5))}
    )


def district_code(df: DataFrame, area: str = "district") -> DataFrame:
    """Alphabetical code from 0, computed on the distinct names only and joined back."""
    from weekloom.runtime import small_side

    return df.join(small_side(order_codes(df.select(area).distinct(), area, "district_enc")), area)


def build_features(df: DataFrame, by: Sequence[str] = SERIES, order: str = "week_start", codes: DataFrame | None = None) -> DataFrame:
    """The whole feature set of a panel that carries season, climate, ``split`` and ``target`` columns.

    ``codes`` is an optional (district, district_enc) lookup already at hand.
    """
    df = df.join(codes, "district") if codes is not None else district_code(df)
    df = climate_lags(df, by, order)
    df = target_rolling(target_lags(df, TARGET_LAGS, by, order), ROLLING_WINDOWS, by, order)
    # Ordered windows first, then whole-series ones (same sort), then the seasonal one (one more sort).
    df = train_statistics(target_trend(df, by, order), by)
    return seasonal_ratio(climate_interactions(df))


def forward_backward_fill(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], order: str = "week_start"
) -> DataFrame:
    """Last seen value, else the next one, else 0, inside each series."""
    back = series_window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = series_window(by, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {
            c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead), F.lit(0))
            for c in columns
        }
    )


def sequences(
    df: DataFrame, columns: Sequence[str], length: int, by: Sequence[str] = SERIES, order: str = "week_start"
) -> DataFrame:
    """The previous ``length`` rows as an array of structs next to the value to predict."""
    f = series_window(by, order).rowsBetween(-length, -1)
    item = F.struct(as_col(order).alias(order), *columns)
    return df.withColumn("steps", F.collect_list(item).over(f)).filter(F.size("steps") == length)


def last_rows(df: DataFrame, n: int, by: Sequence[str] = SERIES, order: str = "week_start") -> DataFrame:
    """Newest ``n`` rows of each series that has at least ``n``."""
    w = Window.partitionBy(*by)
    newest = F.row_number().over(w.orderBy(F.desc(order)))
    return (
        df.withColumns({"newest": newest, "available": F.count("*").over(w)})
        .filter((F.col("newest") <= n) & (F.col("available") >= n))
        .drop("available")
    )
