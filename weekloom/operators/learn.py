"""Learners on MLlib: boosted trees, forests, linear and Poisson baselines, leaf quantiles.

Every fit takes a stored feature table; MLlib distributes the histogram work. Only
models and numbers of the size of the feature list reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.numbers import floor_zero
from weekloom.operators.tidy import align_columns

SEED = 42

def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Feature columns (absent ones and NULLs as 0) to one vector; the names stay in its ML attributes."""
    table = align_columns(df, features, keep)
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(table).select(*keep, "features")


def splits_of(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("split = 'train'"), df.filter("split <> 'train'")


def boosted(df: DataFrame, weight: str | None = None, early_stop: bool = True, **params):
    """Boosted trees, by default with early stopping on the val split."""
    used = ("train", "val") if early_stop else ("train",)
    rows = df.filter(F.col("split").isin(*used)).withColumn("_val", F.col("split") == "val")
    options = {"maxDepth": 4, "maxIter": 20, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7",
               "lossType": "squared", "validationTol": 0.001, **params}
    gbt = GBTRegressor(featuresCol="features", labelCol="target", predictionCol="p", seed=SEED, **options)
    if early_stop:
        gbt = gbt.setValidationIndicatorCol("_val")
    return fit_once(gbt.setWeightCol(weight) if weight else gbt, rows)


def fit_once(estimator, rows: DataFrame):
    """Fit on persisted rows: iterative learners read their input many times."""
    rows = rows.persist()
    model = estimator.fit(rows)
    rows.unpersist()
    return model


def ridge(train: DataFrame, alpha: float = 1.0):
    """L2 linear baseline. The penalty of the summed loss is divided by the row count for the mean loss."""
    n = train.count()
    lr = LinearRegression(featuresCol="features", labelCol="target", predictionCol="p", elasticNetParam=0.0, regParam=alpha / max(n, 1))
    return fit_once(lr, train)


def tree(train: DataFrame):
    return DecisionTreeRegressor(featuresCol="features", labelCol="target", predictionCol="p", maxDepth=5,
                                 minInstancesPerNode=20, seed=SEED).fit(train)


def poisson(train: DataFrame):
    return GeneralizedLinearRegression(featuresCol="features", labelCol="target", predictionCol="p", family="poisson",
                                       link="log", regParam=0.1, maxIter=25).fit(train)


def scored(model, df: DataFrame) -> DataFrame:
    """Predictions, never below zero."""
    return model.transform(df).withColumn("p", floor_zero("p"))


def residual_interval(df: DataFrame, by: Sequence[str] = ("disease", "district"), y: str = "target", p: str = "p",
                      low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Forecast plus the val residual quantiles of its series (at most one row per week each)."""
    w = Window.partitionBy(*by)
    res = F.when(F.col("split") == "val", F.col(y) - F.col(p))
    q = lambda x: F.coalesce(F.percentile(res, F.lit(x)).over(w), F.lit(0.0))
    return df.withColumns({"lower": floor_zero(F.col(p) + q(low)), "upper": floor_zero(F.col(p) + q(high))})


def ar1_baseline(df: DataFrame, by: Sequence[str] = ("disease", "district"), order: str = "week_index", z: float = 1.96) -> DataFrame:
    """First-order autoregression per series, h steps ahead in closed form with a normal band, floored at 0."""
    w = Window.partitionBy(*by).orderBy(order)
    train = F.col("split") == "train"
    y, x = F.when(train, F.col("target").cast("double")), F.lag(F.when(train, F.col("target").cast("double"))).over(w)
    rows = df.withColumns({"_y": y, "_x": x})
    fit = rows.groupBy(*by).agg(
        F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"), F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"), F.regr_count("_y", "_x").alias("_n"),
        F.max(F.when(train, F.col(order))).alias("_t"), F.max_by("target", F.when(train, F.col(order))).alias("_last"))
    fit = fit.withColumns({
        "_b": F.coalesce("_b", F.lit(0.0)), "_a": F.coalesce("_a", F.col("_last").cast("double")),
        "_s2": F.coalesce((F.col("_syy") - F.coalesce("_b", F.lit(0.0)) * F.col("_sxy")) / F.nullif(F.col("_n") - 2, F.lit(0)), F.lit(0.0))})
    h = F.col(order) - F.col("_t")
    b, bh = F.col("_b"), F.pow("_b", h)
    steps = F.when(F.abs(1 - b) < 1e-9, h.cast("double")).otherwise((1 - bh) / (1 - b))
    steps2 = F.when(F.abs(1 - b * b) < 1e-9, h.cast("double")).otherwise((1 - bh * bh) / (1 - b * b))
    p = bh * F.col("_last") + F.col("_a") * steps
    gap = F.lit(z) * F.sqrt(F.greatest(F.col("_s2") * steps2, F.lit(0.0)))
    return (
        df.filter(~train).join(fit, list(by))
        .withColumns({"p": floor_zero(p), "lower": floor_zero(p - gap), "upper": floor_zero(p + gap)})
        .drop("_b", "_a", "_syy", "_sxy", "_n", "_t", "_last", "_s2")
    )


def mean_std_fallback(df: DataFrame, by: Sequence[str] = ("disease",), z: float = 1.96) -> DataFrame:
    """Constant forecast: train mean with a normal band."""
    from weekloom.runtime import small_side

    s = df.filter("split = 'train'").groupBy(*by).agg(F.avg("target").alias("_m"), F.stddev_pop("target").alias("_s"))
    m, gap = F.col("_m"), F.col("_s") * z
    return (
        df.filter("split <> 'train'").join(small_side(s), list(by))
        .withColumns({"p": floor_zero(m), "lower": floor_zero(m - gap), "upper": floor_zero(m + gap)}).drop("_m", "_s")
    )


def top_places(gains: Sequence[float], features: Sequence[str], drop: float, at_least: int = 10) -> list[int]:
    """Places of the features kept by importance, best first; ties by name."""
    keep = max(at_least, int((1.0 - drop) * len(features)))
    return sorted(range(len(features)), key=lambda i: (-gains[i], features[i]))[:keep]


def sliced(df: DataFrame, places: Mapping[str, Sequence[int]], by: str = "disease") -> DataFrame:
    """The feature vector reduced to the places of the row's group."""
    x = vector_to_array("features")
    picked = F.lit(None).cast("array<double>")
    for group, own in places.items():
        picked = F.when(F.col(by) == group, F.transform(F.array(*[F.lit(int(i)) for i in own]), lambda i: F.get(x, i))).otherwise(picked)
    return df.withColumn("features", array_to_vector(picked))
