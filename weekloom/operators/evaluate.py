"""Forecast quality: errors, intervals, comparisons and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.dates import as_col
from weekloom.functions.numbers import ratio
from weekloom.operators.rank import exact_quantiles


def error_columns(y: Column | str, p: Column | str) -> dict[str, Column]:
    """mae, rmse and r2; r2 is NULL where the actuals do not vary."""
    y, p = as_col(y), as_col(p)
    e = y - p
    sst = F.count(y) * F.var_pop(y)
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": F.lit(1.0) - ratio(F.sum(e * e), sst),
    }


def regression_metrics(df: DataFrame, by: Sequence[str], y: str = "target", p: str = "p") -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in error_columns(y, p).items()], F.count("*").alias("n"))


def interval_metrics(df: DataFrame, by: Sequence[str], y: str = "target", low: str = "lower", high: str = "upper") -> DataFrame:
    inside = F.col(y).between(F.col(low), F.col(high)).cast("double")
    return df.groupBy(*by).agg(F.avg(inside).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width"))


def melt_models(df: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(models), "model", "p")


def baseline_compare(df: DataFrame, by: Sequence[str], y: str = "target", p: str = "p") -> DataFrame:
    """Test MAE of the forecast, of the train mean and of the train median; gain against the mean."""
    from weekloom.runtime import small_side

    train = df.filter("split = 'train'")
    mean = train.groupBy(*by).agg(F.avg(y).alias("_mean"))
    median = exact_quantiles(train, by, y, {"_median": 0.5})
    test = df.filter("split = 'test'").join(small_side(mean.join(median, list(by))), list(by))
    mae = lambda c: F.avg(F.abs(F.col(y) - F.col(c)))
    out = test.groupBy(*by).agg(mae(p).alias("mae"), mae("_mean").alias("mae_mean"), mae("_median").alias("mae_median"))
    return out.withColumn("gain_pct", ratio(F.col("mae_mean") - F.col("mae"), F.col("mae_mean")) * 100)


def model_comparison(scores: DataFrame, models: Sequence[str], metrics: Sequence[str] = ("mae", "rmse", "r2")) -> DataFrame:
    """(disease, model, metrics) to one wide row per disease; the model list is declared, so no discovery pass."""
    return scores.groupBy("disease").agg(*[
        F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{m}_{x}") for m in models for x in metrics])


def model_ranking(scores: DataFrame, digits: int = 9) -> DataFrame:
    """Best model by MAE, RMSE and R2; the alphabetically first name wins a tie."""
    best = lambda c: F.min(F.struct(F.round(c, digits), F.col("model").alias("model"))).getField("model")
    return scores.groupBy("disease").agg(
        best(F.col("mae")).alias("best_mae"), best(F.col("rmse")).alias("best_rmse"), best(-F.col("r2")).alias("best_r2"))


def mae_improvement(wide: DataFrame, base: str, models: Sequence[str]) -> DataFrame:
    """Mean percentage gain in MAE of each model against the baseline."""
    b = F.col(f"{base}_mae")
    return wide.agg(*[F.avg(ratio(b - F.col(f"{m}_mae"), b) * 100).alias(f"{m}_gain_pct") for m in models])


def normalised_mae(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    top = F.greatest(*[F.col(f"{m}_mae") for m in models])
    return wide.select("disease", *[ratio(F.col(f"{m}_mae"), top).alias(m) for m in models])


def best_by_r2(scores: DataFrame, by: Sequence[str] = ("disease",), digits: int = 9) -> DataFrame:
    """The whole row with the highest R2; the smallest label wins a tie."""
    rest = [c for c in scores.columns if c not in by and c != "model"]
    row = F.min(F.struct(F.round(-F.col("r2"), digits).alias("k"), "model", *rest)).alias("b")
    return scores.groupBy(*by).agg(row).select(*by, "b.model", *[f"b.{c}" for c in rest])


def winner(wide: DataFrame, first: str, second: str) -> DataFrame:
    """Which of two models has the higher R2, and by how much."""
    a, b = F.col(f"{first}_r2"), F.col(f"{second}_r2")
    return wide.select("disease", F.when(a > b, first).otherwise(second).alias("winner"), (a - b).alias("difference"))


def overfit_flag(scores: DataFrame, std: str = "std") -> DataFrame:
    return scores.withColumns({"poor": F.col("r2") < -0.1, "rmse_to_std": ratio(F.col("rmse"), F.col(std))})


def mean_abs_contribution(df: DataFrame, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.avg(F.abs(F.col(f))).alias("mean_abs")) for f in features])
    out = df.agg(cells.alias("cells")).select(F.inline("cells")).orderBy(F.desc("mean_abs"), "feature")
    return out.limit(top) if top else out
