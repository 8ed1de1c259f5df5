"""The per-disease chain: two learners, their intervals, blend, area bias and metrics, over a model store.

Fits of several diseases run at once from driver threads over one stored feature
table; each is an MLlib job of its own. What is stored is never fitted again:
predictions, curves, explanations and serving read the store.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.functions.numbers import blend as mixed
from weekloom.functions.numbers import floor_zero
from weekloom.operators import blend, evaluate, learn
from weekloom.operators.drift import edge_bin, quantile_edges
from weekloom.sources.models import ModelStore

AT_ONCE = 2
ROWS_PER_TASK = 50_000
LEARNERS = ("boosted", "forest")


@dataclass(frozen=True)
class Setting:
    """Of one disease: depth, share of rows and features per tree, least rows of a leaf, limits of rounds, patience of the stop, area bias."""

    depth: int
    rows: float
    columns: float
    least: int
    most_rounds: int
    least_rounds: int = 1
    patience: int = 50
    bias: bool = True
    step: float = 0.1
    trees: int = 40


# Fixed values per disease; the step is larger than with a local booster, as each round is a Spark job.
SETTINGS: dict[str, Setting] = {
    "leptospirosis": Setting(4, 0.5, 0.5, 30, 600),
    "typhus": Setting(2, 0.4, 0.4, 40, 500, 50, bias=False),
    "hepatitis_a": Setting(2, 0.4, 0.4, 50, 500, patience=30),
    "chickenpox": Setting(3, 0.5, 0.5, 30, 600, 100),
}


def at_once(spark: SparkSession, jobs: Sequence[Callable[[], object]], limit: int = AT_ONCE) -> list:
    """Results of driver-side jobs, at most ``limit`` running; each keeps the session's local properties."""
    with ThreadPoolExecutor(limit) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def rare_weights(df: DataFrame, value: str = "target", bins: int = 10) -> DataFrame:
    """``weight``: 1 / sqrt(rows of the target's decile), mean 1 over the train rows; other rows weigh 1."""
    train = df.filter("split = 'train'")
    cell = edge_bin(F.col(value), quantile_edges(train, value, bins))
    rows = {r.k: r.n for r in train.groupBy(cell.alias("k")).agg(F.count("*").alias("n")).collect()}  # at most ``bins`` rows
    mean = sum(math.sqrt(n) for n in rows.values()) / max(sum(rows.values()), 1)
    raw = F.get(F.array(*[F.lit(1 / math.sqrt(rows[k]) / mean if k in rows else 1.0) for k in range(bins)]), cell)
    return df.withColumn("weight", F.when(F.col("split") == "train", raw).otherwise(1.0))


def stop_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """(best round, whether the errors stayed above it for ``patience`` rounds); rounds count from 1."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_boosted(rows: DataFrame, s: Setting) -> dict[str, object]:
    """Boosted trees on weighted train rows, stopped by the val error inside the setting's limits.

    Rounds are doubled until the val error has not fallen for ``patience`` rounds. ``boosted`` has
    the rounds up to the stop, ``boosted_all`` all that were tried, for the curve. The rounds of
    one seed do not depend on their number, so the second fit repeats the first one's start.
    """
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    options = {"maxDepth": s.depth, "stepSize": s.step, "subsamplingRate": s.rows, "featureSubsetStrategy": str(s.columns), "minInstancesPerNode": s.least}
    fit = lambda n: learn.boosted(train, "weight", early_stop=False, maxIter=n, **options)
    rounds = min(max(s.patience + 1, s.least_rounds), s.most_rounds)
    while True:
        model = fit(rounds)
        best, ended = stop_round(model.evaluateEachIteration(val, "absolute"), s.patience)
        if ended or rounds == s.most_rounds:
            break
        rounds = min(2 * rounds, s.most_rounds)
    stop = min(max(best, s.least_rounds), rounds)
    return {"boosted": fit(stop) if stop < rounds else model, "boosted_all": model}


def fit_forest(rows: DataFrame, s: Setting) -> dict[str, object]:
    from pyspark.ml.regression import RandomForestRegressor

    return {"forest": learn.fit_once(RandomForestRegressor(
        featuresCol="features", labelCol="target", predictionCol="p", weightCol="weight", numTrees=s.trees, maxDepth=6, minInstancesPerNode=5,
        subsamplingRate=0.8, featureSubsetStrategy="onethird", seed=learn.SEED), rows.filter("split = 'train'"))}


FITS = {"boosted": fit_boosted, "forest": fit_forest}

# Named parameter sets of the search (depth, step, share of rows, share of features).
NAMED_SETS: dict[str, tuple[int, float, float, float]] = {
    "Aggressive_L2": (2, 0.02, 0.6, 0.6),
    "Feature_Pruning": (3, 0.015, 0.75, 0.5),
    "Conservative_Training": (2, 0.01, 0.5, 0.5),
    "Stacking_Light": (3, 0.01, 0.8, 0.7),
    "Ensemble_Balance": (4, 0.015, 0.85, 0.8),
    "Iteration_1": (4, 0.05, 0.8, 0.8),
    "Iteration_2": (3, 0.03, 0.7, 0.7),
    "Iteration_3": (5, 0.02, 0.85, 0.85),
}


def slices_of(table: DataFrame, diseases: Sequence[str]) -> dict[str, DataFrame]:
    """Weighted rows of each disease that has any, kept in few partitions until ``unpersist``."""
    sizes = {r.disease: r.n for r in table.groupBy("disease").agg(F.count("*").alias("n")).collect()}

    def kept(disease: str) -> DataFrame:
        rows = table.filter(F.col("disease") == disease).select("split", "target", "features")
        return rare_weights(rows).coalesce(math.ceil(sizes[disease] / ROWS_PER_TASK)).persist()

    have = [d for d in diseases if d in sizes]
    return dict(zip(have, at_once(table.sparkSession, [lambda d=d: kept(d) for d in have])))


def fit_each(table: DataFrame, fit: Callable[[DataFrame, str], object], diseases: Sequence[str] = tuple(SETTINGS)) -> dict[str, object]:
    """``fit(rows, disease)`` of every disease, several at once; the models are not stored."""
    slices = slices_of(table, diseases)
    models = at_once(table.sparkSession, [lambda d=d: fit(slices[d], d) for d in slices])
    for s in slices.values():
        s.unpersist()
    return dict(zip(slices, models))


def scored_each(table: DataFrame, models: Mapping[str, object], keep: Sequence[str]) -> DataFrame:
    """Predictions of each disease's own model, never below zero."""
    out = None
    for disease, model in sorted(models.items()):
        rows = learn.scored(model, table.filter(F.col("disease") == disease)).select(*keep, "p")
        out = rows if out is None else out.unionByName(rows)
    return out


def named_search(table: DataFrame, sets: Mapping[str, tuple[int, float, float, float]] = NAMED_SETS, rounds: int = 8, step_scale: float = 5.0,
                 diseases: Sequence[str] = tuple(SETTINGS)) -> list[tuple]:
    """Successive halving of the named sets per disease: (disease, config, rounds, val MAE, stage left at, winner).

    Every stage fits the sets that are left with twice the rounds of the one before, several at
    once, and keeps the better half by the val error of their best round. ``step_scale`` makes
    up for far fewer rounds than a local booster takes.
    """
    slices = slices_of(table, diseases)
    left = {d: list(sets) for d in slices}
    out: dict[tuple[str, str], tuple] = {}
    stage = 0
    while True:
        stage += 1

        def rated(disease: str, name: str) -> tuple:
            depth, step, rows, columns = sets[name]
            model = learn.boosted(slices[disease].filter("split = 'train'"), "weight", early_stop=False, maxIter=rounds, maxDepth=depth,
                                  stepSize=step * step_scale, subsamplingRate=rows, featureSubsetStrategy=str(columns))
            errors = model.evaluateEachIteration(slices[disease].filter("split = 'val'"), "absolute")
            return min((e, i + 1) for i, e in enumerate(errors))

        jobs = [(d, n) for d in left for n in left[d]]
        for (d, n), (error, at) in zip(jobs, at_once(table.sparkSession, [lambda d=d, n=n: rated(d, n) for d, n in jobs])):
            out[d, n] = (at, error, stage)
        if all(len(names) == 1 for names in left.values()):
            break
        left = {d: sorted(names, key=lambda n: (out[d, n][1], n))[: max(1, len(names) // 2)] for d, names in left.items()}
        if all(len(names) == 1 for names in left.values()):
            break
        rounds *= 2
    for s in slices.values():
        s.unpersist()
    return [(d, n, at, error, stage, n in left[d]) for (d, n), (at, error, stage) in sorted(out.items())]


def fit_all(table: DataFrame, features: Sequence[str], store: ModelStore, parts: Sequence[str] = LEARNERS, settings: Mapping[str, Setting] = SETTINGS) -> None:
    """Fit and store what is missing of every (disease, part); ``table`` is assembled and stored."""
    have = store.listed()
    missing = [(d, p) for p in parts for d in settings if (d, p) not in have]
    if not missing:
        return
    slices = slices_of(table, [d for d in settings if any(d == m for m, _ in missing)])

    def fit(disease: str, part: str) -> None:
        models = FITS[part](slices[disease], settings[disease])
        for name in sorted(models, key=lambda n: n == part):  # the part that is asked for comes last
            store.save(disease, name, models[name], list(features), rounds=models[part].getNumTrees)

    at_once(table.sparkSession, [lambda d=d, p=p: fit(d, p) for d, p in missing if d in slices])
    for s in slices.values():
        s.unpersist()


def predicted(table: DataFrame, store: ModelStore, part: str, keep: Sequence[str], p: str = "p") -> DataFrame:
    """Predictions of a stored learner of every disease, never below zero."""
    out = None
    for disease, have in sorted(store.listed()):
        if have == part:
            rows = store.load(disease, part).transform(table.filter(F.col("disease") == disease)).select(*keep, floor_zero("p").alias(p))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise LookupError(f"no {part} model is stored")
    return out


# ---- forest quantiles ------------------------------------------------------------------------------

def forest_quantiles(model, train: DataFrame, df: DataFrame, probs: Mapping[str, float], keys: Sequence[str], y: str = "target") -> DataFrame:
    """Quantile regression forest: (keys, quantiles) of the train targets under the forest's weights of each row.

    A train row weighs 1 / (trees x rows of the leaf) for every tree in which it shares the
    row's leaf. Leaves meet in an equi-join on (tree, leaf) with the distinct targets of a
    leaf, so nothing grows with trees x leaves in a task; the quantile is the smallest
    target whose weights reach the probability. Rows that share no leaf are left out.
    """
    cells = lambda d, *cols: model.setLeafCol("leaf").transform(d).select(*cols, F.posexplode(vector_to_array("leaf")).alias("tree", "x")).withColumn("leaf", F.col("x").cast("int")).drop("x")
    counts = cells(train, y).groupBy("tree", "leaf", F.col(y).cast("double").alias("v")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("tree", "leaf").agg(F.sum("n").alias("size"))
    members = counts.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "v", (F.col("n") / F.col("size") / model.getNumTrees).alias("w"))
    weights = cells(df, *keys).join(members, ["tree", "leaf"]).groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    upto = Window.partitionBy(*keys).orderBy("v")
    run = weights.withColumn("c", F.sum("w").over(upto))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("c") >= p - 1e-9, F.col("v"))).alias(q) for q, p in probs.items()])


def forest_intervals(table: DataFrame, store: ModelStore, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """``forest_quantiles`` of the held-out rows under every disease's stored forest."""
    out = None
    for disease, part in sorted(store.listed()):
        if part == "forest":
            rows = table.filter(F.col("disease") == disease)
            q = forest_quantiles(store.load(disease, part), rows.filter("split = 'train'"), rows.filter("split <> 'train'"), probs, keys)
            out = q if out is None else out.unionByName(q)
    if out is None:
        raise LookupError("no forest is stored")
    return out


# ---- the chain ---------------------------------------------------------------------------------------

BOUNDS = {"lower": 0.05, "median": 0.5, "upper": 0.95}


def learner_intervals(table: DataFrame, store: ModelStore, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Held-out rows with point and interval of both learners.

    ``a`` is the boosted learner with its val residual quantiles per disease, ``b`` the forest
    with the quantiles of its leaves.
    """
    held = table.filter("split <> 'train'")
    a, b = predicted(held, store, "boosted", keep, "a"), predicted(held, store, "forest", keep, "b")
    spread = a.filter("split = 'val'").groupBy("disease").agg(*[F.percentile(F.col("target") - F.col("a"), F.lit(p)).alias(f"_{q}") for q, p in BOUNDS.items() if q != "median"])
    a = a.join(spread, "disease", "left").select(
        *keep, "a", floor_zero(F.col("a") + F.coalesce("_lower", F.lit(0.0))).alias("a_lower"), F.col("a").alias("a_median"), floor_zero(F.col("a") + F.coalesce("_upper", F.lit(0.0))).alias("a_upper"))
    leaf = forest_intervals(table, store, keys, {f"b_{q}": p for q, p in BOUNDS.items()})
    return a.join(b.select(*keys, "b"), list(keys)).join(leaf, list(keys), "left")


def blended(parts: DataFrame, settings: Mapping[str, Setting] = SETTINGS) -> DataFrame:
    """Weight by least squares and area bias on val, both per disease; ordered bounds, never below zero."""
    val = parts.filter("split = 'val'")
    weights = blend.closed_form_weight(val, ["disease"]).select("disease", F.col("weight_a").alias("weight"))
    rows = parts.join(weights, "disease", "left").withColumn("weight", F.coalesce("weight", F.lit(0.5)))
    rows = rows.withColumns({
        "raw": mixed("a", "b", F.col("weight")),
        **{q: mixed(f"a_{q}", f"b_{q}" if q != "median" else "b", F.col("weight")) for q in BOUNDS}})
    biased = [d for d, s in settings.items() if s.bias]
    factors = blend.district_bias(rows.filter(F.col("split") == "val").filter(F.col("disease").isin(biased)), p="raw")
    scaled = rows.join(factors, ["disease", "district"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return blend.ordered_interval(scaled.withColumns({q: F.col(q) * F.col("factor") for q in BOUNDS}))


def metrics(rows: DataFrame, split: str = "test") -> DataFrame:
    """Errors of both learners and the blend, coverage and width of the interval, per disease."""
    held = rows.filter(F.col("split") == split)
    errors = [c.alias(f"{n}_{x}") for x, p in (("blend", "median"), ("boosted", "a"), ("forest", "b")) for n, c in evaluate.error_columns("target", p).items()]
    inside = F.col("target").between(F.col("lower"), F.col("upper")).cast("double")
    return held.groupBy("disease").agg(*errors, F.avg(inside).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"), F.max("weight").alias("weight"), F.count("*").alias("n"))


# ---- learning curve ------------------------------------------------------------------------------------

def staged_errors(table: DataFrame, store: ModelStore, part: str, keys: Sequence[str]) -> DataFrame:
    """(disease, learner, split, round, mae, rmse, best, stop): every round of a stored learner from one scoring.

    The leaves of a row give one value per tree; running sums over the trees (means for a
    forest) are the predictions after each round. ``stop`` marks the round that is served.
    """
    listed = store.listed()
    name = "boosted_all" if part == "boosted" else part
    out = None
    for disease in sorted(d for d, p in listed if p == name):
        model = store.load(disease, name).setLeafCol("leaf")
        rows = model.transform(table.filter(F.col("disease") == disease)).select(*keys, "split", "target", F.posexplode(vector_to_array("leaf")).alias("tree", "x"))
        step = rows.withColumn("leaf", F.col("x").cast("int")).join(store.leaves(disease, name), ["tree", "leaf"])
        upto = Window.partitionBy(*keys).orderBy("tree")
        if part == "boosted":
            p = F.sum(F.col("value") * F.col("weight")).over(upto)
        else:
            p = F.avg("value").over(upto)
        e = F.col("target") - F.col("p")
        one = step.withColumn("p", floor_zero(p)).groupBy("split", (F.col("tree") + 1).alias("round")).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
        one = one.select(F.lit(disease).alias("disease"), F.lit(part).alias("learner"), "*", (F.col("round") == int(listed[disease, name]["facts"]["rounds"])).alias("stop"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise LookupError(f"no {part} model is stored")
    best = F.min(F.struct(F.round("mae", 9), "round")).over(Window.partitionBy("disease", "split"))
    return out.withColumn("best", best.getField("round") == F.col("round"))
