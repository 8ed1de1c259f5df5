"""Descriptive profiles of the panel. Each is one or two passes of mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.numbers import ratio
from weekloom.operators.rank import exact_quantiles, quantile_values
from weekloom.runtime import small_side

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Numeric columns to (name, value) rows, all as doubles."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, pct) sorted by the number of missing cells."""
    types = dict(df.dtypes)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), (F.count("*") - F.count(c)).alias("nulls"),
                 (100.0 * (F.count("*") - F.count(c)) / F.count("*")).alias("pct"))
        for c in df.columns
    ])
    return df.agg(cells.alias("cells")).select(F.inline("cells")).orderBy(F.desc("nulls"), "column")


def basic_stats(value: str = "value") -> list:
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"), F.sum(value).alias("total"),
    ]


def describe_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column."""
    long = melt(df, [], columns)
    stats = long.groupBy("variable").agg(*basic_stats())
    return stats.join(exact_quantiles(long, ["variable"], "value", QUARTILES), "variable")


def dataset_overview(df: DataFrame, area: str = "district", week: str = "week_start") -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(area).alias("districts"), F.min(week).alias("first_week"),
        F.max(week).alias("last_week"), F.countDistinct(week).alias("weeks"), F.datediff(F.max(week), F.min(week)).alias("days"),
    ).withColumn("columns", F.lit(len(df.columns)))


def stats_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(*basic_stats(value))


def disease_summary(df: DataFrame) -> DataFrame:
    """Total, average, largest week and number of areas with any case, from area totals."""
    areas = df.groupBy("disease", "district").agg(
        F.sum("target").alias("t"), F.count("target").alias("n"), F.max("target").alias("m"))
    return areas.groupBy("disease").agg(
        F.sum("t").alias("total"), (F.sum("t") / F.sum("n")).alias("mean"), F.max("m").alias("highest"),
        F.count_if(F.col("t") > 0).alias("districts"))


def outlier_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartile fences per column with the number and share of values outside; rows are kept."""
    long = melt(df, [], columns).filter(F.col("value").isNotNull())
    q = exact_quantiles(long, ["variable"], "value", {"q1": 0.25, "q3": 0.75})
    gap = F.col("q3") - F.col("q1")
    fences = q.select("variable", "q1", "q3", (F.col("q1") - k * gap).alias("low"), (F.col("q3") + k * gap).alias("high"))
    # One row per profiled column: bounded by the argument list.
    out = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return (
        long.join(F.broadcast(fences), "variable").groupBy("variable", "q1", "q3", "low", "high")
        .agg(F.count_if(out).alias("outliers"), F.count("*").alias("n"))
        .withColumn("pct", 100.0 * F.col("outliers") / F.col("n"))
    )


def shape_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Biased skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"), F.count(value).alias("n"))


def normality_jb(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Jarque-Bera statistic and its chi-square (2 degrees) tail probability."""
    jb = F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4.0)
    return shape_stats(df, by, value).withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2)).withColumn(
        "normal", F.col("p_value") > 0.05)


MERGE_TASKS = 64


def _merged_moments(x, y):
    """Two sets of pairwise moments (n, mean x, mean y, Cxx, Cyy, Cxy), each a matrix, as one."""
    import numpy as np

    n = x[0] + y[0]
    part = np.divide(y[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = y[1] - x[1], y[2] - x[2]
    w = x[0] * part
    return np.stack([n, x[1] + dx * part, x[2] + dy * part, x[3] + y[3] + dx * dx * w, x[4] + y[4] + dy * dy * w, x[5] + y[5] + dx * dy * w])


def _pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete (i, j, n, vx, vy, cov): centred sums of squares and products, one pass over the rows.

    A single aggregate with hundreds of ``corr`` calls outgrows generated code, so a task folds
    its Arrow batches into one small matrix per moment, each batch centred on its own means
    first. Moments of batches and tasks merge pairwise, in two levels of tasks, so nothing
    is centred beforehand and large values do not cancel.
    """
    import numpy as np
    import pandas as pd

    k = len(columns)
    num = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def row(total):
        from pyspark import TaskContext

        return pd.DataFrame({"part": [TaskContext.get().partitionId()], "moments": [total.ravel()]})

    def fold(batches):
        total = np.zeros((6, k, k))
        for b in batches:
            x = b.to_numpy(dtype=float)
            ok = ~np.isnan(x)
            centre = np.where(ok, x, 0.0).sum(axis=0) / np.maximum(ok.sum(axis=0), 1)
            x, m = np.where(ok, x - centre, 0.0), ok.astype(float)
            n, s, q = m.T @ m, x.T @ m, (x * x).T @ m
            some = np.maximum(n, 1.0)
            total = _merged_moments(total, np.stack([
                n, np.where(n > 0, centre[:, None] + s / some, 0.0), np.where(n > 0, centre[None, :] + s.T / some, 0.0),
                q - s * s / some, q.T - s.T * s.T / some, x.T @ x - s * s.T / some]))
        yield row(total)

    def merge(batches):
        total = np.zeros((6, k, k))
        for b in batches:
            for m in b["moments"]:
                total = _merged_moments(total, np.asarray(m, dtype=float).reshape(6, k, k))
        yield row(total)

    def flat(batches):
        i, j = np.indices((k, k))
        for b in merge(batches):
            total = b["moments"][0].reshape(6, k, k)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{n: total[t].ravel() for n, t in (("n", 0), ("vx", 3), ("vy", 4), ("cov", 5))}})

    cells = "part int, moments array<double>"
    parts = num.mapInPandas(fold, cells).repartition(MERGE_TASKS, "part").mapInPandas(merge, cells)
    sums = parts.repartition(1).mapInPandas(flat, "i int, j int, n double, vx double, vy double, cov double")  # MERGE_TASKS rows
    names = F.array(*[F.lit(c) for c in columns])
    return sums.withColumns({"left": names[F.col("i")], "right": names[F.col("j")]})


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair in long form, NULLs skipped per pair."""
    return _pair_moments(df, columns).select("left", "right", ratio(F.col("cov"), F.sqrt(F.col("vx") * F.col("vy"))).alias("corr"))


def corr_pairs(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Correlations between two column lists."""
    return corr_matrix(df, [*left, *right]).filter(F.col("left").isin(*left) & F.col("right").isin(*right))


def lag_corr(df: DataFrame, lagged: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(variable, lag, disease, corr) of every lagged climate column with every disease."""
    return corr_pairs(df, lagged, targets).select(
        F.regexp_extract("left", r"^(.*)_lag_(\d+)$", 1).alias("variable"),
        F.regexp_extract("left", r"^(.*)_lag_(\d+)$", 2).cast("int").alias("lag"),
        F.col("right").alias("disease"), "corr")


def best_lag(corr: DataFrame, digits: int = 9) -> DataFrame:
    """Per disease and variable the lag with the largest absolute correlation; the shorter lag wins a tie."""
    key = F.struct(F.round(F.abs("corr"), digits), -F.col("lag"))
    return corr.groupBy("disease", "variable").agg(F.max_by(F.struct("lag", "corr"), key).alias("b")).select(
        "disease", "variable", "b.lag", "b.corr")


def extreme_rain(df: DataFrame, rain: str, p: float = 0.95) -> DataFrame:
    """Mean cases in weeks above the rain quantile against all others, per disease."""
    cut = quantile_values(df, rain, [p])[0]
    wet = F.coalesce(F.col(rain) > cut, F.lit(False))
    normal, extreme = F.avg(F.when(~wet, F.col("target"))), F.avg(F.when(wet, F.col("target")))
    return df.groupBy("disease").agg(
        F.count_if(wet).alias("extreme_weeks"), normal.alias("normal_mean"), extreme.alias("extreme_mean"),
        (ratio(extreme - normal, normal) * 100).alias("change_pct"))


def zscore_anomaly(df: DataFrame, limit: float = 2.5) -> DataFrame:
    """Rows further than ``limit`` population deviations from their disease's mean."""
    stats = df.groupBy("disease").agg(F.avg("target").alias("_m"), F.stddev_pop("target").alias("_s"))
    z = ratio(F.col("target") - F.col("_m"), F.col("_s"))
    return df.join(small_side(stats), "disease").withColumn("z", z).filter(F.abs("z") > limit).drop("_m", "_s")


def anomaly_summary(rows: DataFrame) -> DataFrame:
    """Number of anomalies, the largest value and where it was; ties go to the first area."""
    peak = F.min(F.struct(-F.col("target"), "district", "week_start")).alias("p")
    return rows.groupBy("disease").agg(F.count("*").alias("anomalies"), F.max("target").alias("peak"), peak).select(
        "disease", "anomalies", "peak", F.col("p.district").alias("peak_district"), F.col("p.week_start").alias("peak_week"))


def equal_width_bins(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width counts per column between its own minimum and maximum; the last bin is closed."""
    span = df.agg(F.struct(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns])).scalar()
    low = F.create_map(*[x for c in columns for x in (F.lit(c), span.getField(f"lo_{c}"))])
    high = F.create_map(*[x for c in columns for x in (F.lit(c), span.getField(f"hi_{c}"))])
    name = F.col("variable")
    long = melt(df, [], columns).filter(F.col("value").isNotNull())
    return long.groupBy("variable", bin_index(F.col("value"), low[name], high[name], bins).alias("bin")).agg(F.count("*").alias("n"))


def bin_index(x, low, high, bins: int):
    """0-based equal-width bin; values on or beyond the ends fall into the outer bins."""
    k = F.floor(ratio(x - low, high - low) * bins)
    return F.coalesce(F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Numbers behind a box plot: min, quartiles and max per group."""
    return exact_quantiles(df, by, value, {"lowest": 0.0, **QUARTILES, "highest": 1.0})


def multivariate_anomaly(df: DataFrame, columns: Sequence[str], share: float = 0.05) -> DataFrame:
    """Rows whose squared Mahalanobis distance is above its (1 - share) quantile.

    Means and covariances are one aggregate row; the small matrix (one row per
    column) is inverted on the driver and used as a column expression.
    """
    import numpy as np

    full = df.na.drop(subset=list(columns))
    k = len(columns)
    row = full.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inv = np.linalg.pinv(cov)
    d = [F.col(c) - F.lit(float(row[f"m{i}"])) for i, c in enumerate(columns)]
    dist = sum(
        (d[i] * d[j] * F.lit(float(inv[i, j] * (1 if i == j else 2))) for i in range(k) for j in range(i, k)), F.lit(0.0))
    scored = full.withColumn("distance", dist)
    return scored.filter(F.col("distance") > quantile_values(scored, "distance", [1.0 - share])[0])
