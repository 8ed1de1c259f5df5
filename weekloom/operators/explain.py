"""Model explanations by re-scoring rows with one feature replaced."""

from __future__ import annotations

import json
import random
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.rank import row_positions


def _replaced(df: DataFrame, positions: Sequence[int], other: str) -> DataFrame:
    """One copy of each row per position, its feature there taken from the array ``other``."""
    df = df.withColumn("j", F.explode(F.array(*[F.lit(int(i)) for i in positions])))
    x = F.transform("_x", lambda v, i: F.when(i == F.col("j"), F.get(F.col(other), i)).otherwise(v))
    return df.withColumn("features", array_to_vector(x))


def permutation_importance(model, df: DataFrame, features: Sequence[str], chosen: Sequence[str], keys: Sequence[str], seed: int = 7) -> DataFrame:
    """Rise of the MAE when one feature's column is shuffled.

    Each row gets one partner row by joining two distributed hash orders; all chosen
    features are then re-scored in a single exploded pass.
    """
    rows = df.withColumn("_x", vector_to_array("features"))
    order = lambda s: [F.xxhash64(*keys, F.lit(s)), *keys]
    left = row_positions(rows, [], order(seed), "at").drop("at_total")
    right = row_positions(rows.select(*keys, F.col("_x").alias("_other")), [], order(seed + 1), "at").select("at", "_other")
    paired = left.join(right, "at")
    base = model.transform(df).agg(F.avg(F.abs(F.col("target") - F.col("p")))).scalar()
    names = F.array(*[F.lit(f) for f in features])
    swapped = model.transform(_replaced(paired, [list(features).index(f) for f in chosen], "_other"))
    mae = F.avg(F.abs(F.col("target") - F.col("p")))
    return swapped.groupBy("j").agg(mae.alias("mae")).select(
        F.get(names, F.col("j")).alias("feature"), (F.col("mae") - base).alias("rise"))


def orders(d: int, pairs: int, seed: int = 7) -> list[list[int]]:
    """``2 * pairs`` orders of ``d`` features as places; each second one is the reverse of the one before."""
    rng = random.Random(seed)
    out = []
    for _ in range(pairs):
        place = list(range(d))
        rng.shuffle(place)
        out += [place, [d - 1 - p for p in place]]
    return out


def background(train: DataFrame, rows: int) -> list[list[float]]:
    """``rows`` train vectors, the first by a hash of their values: the reference inputs of the contributions."""
    x = vector_to_array("features")
    picked = train.select(x.alias("x")).withColumn("h", F.xxhash64(F.col("x").cast("string"))).distinct().orderBy("h").limit(rows).collect()
    return [list(r.x) for r in picked]


def shapley(model, df: DataFrame, reference: Sequence[Sequence[float]], features: Sequence[str], keys: Sequence[str], pairs: int = 2, seed: int = 7) -> DataFrame:
    """(keys, base, forecast, feature, contribution): Shapley values over sampled orders of the features.

    Along an order the features change one by one from a reference row to the explained row;
    a feature's contribution is the mean change of the model's output at its step. Orders
    come in antithetic pairs, and each pair has one reference row. The coalitions of a row are
    exploded and scored in one pass. ``base`` is the mean output of the reference rows used,
    and base + contributions = forecast exactly but for rounding.
    """
    d = len(features)
    places = orders(d, pairs, seed)
    cells = [(m, list(map(float, reference[m // 2 % len(reference)])), p) for m, p in enumerate(places)]
    plans = F.from_json(F.lit(json.dumps([{"m": m, "z": z, "place": p} for m, z, p in cells])), "array<struct<m:int,z:array<double>,place:array<int>>>")
    rows = df.select(*keys, vector_to_array("features").alias("_x")).select("*", F.explode(plans).alias("o"))
    steps = rows.select(*keys, "o.m", "o.place", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"), array_to_vector(F.transform(
        "_x", lambda v, i: F.when(F.get(F.col("o.place"), i) < F.col("step"), v).otherwise(F.get(F.col("o.z"), i)))).alias("features"))
    scored = model.transform(steps).groupBy(*keys, "m").agg(
        F.first("place").alias("place"), F.transform(F.sort_array(F.collect_list(F.struct("step", "p"))), lambda s: s.getField("p")).alias("ps"))  # d + 1 numbers
    names = F.array(*[F.lit(f) for f in features])
    parts = scored.select(*keys, "m", F.get("ps", F.lit(0)).alias("first"), F.get("ps", F.lit(d)).alias("last"), F.posexplode(
        F.transform("place", lambda p: F.get(F.col("ps"), p + 1) - F.get(F.col("ps"), p))).alias("j", "delta"))
    return parts.groupBy(*keys, "j").agg(F.avg("first").alias("base"), F.avg("last").alias("forecast"), F.avg("delta").alias("contribution")).select(
        *keys, "base", "forecast", F.get(names, F.col("j")).alias("feature"), "contribution")


def linear_contribution(coefficients: Sequence[float], train: DataFrame, df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Exact additive terms of a linear model: coefficient times the distance from the train mean."""
    mean = train.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(float(k)) * (F.col(c) - mean.getField(c))).alias("contribution"))
        for c, k in zip(columns, coefficients)])
    return df.select(*keys, F.inline(cells))


def strongest(df: DataFrame, by: Sequence[str], n: int, value: str = "contribution") -> DataFrame:
    """The ``n`` rows of each key with the largest absolute value."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs(value)), "feature")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
