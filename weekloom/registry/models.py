"""Queries over blending, learners, explanations, serving lookups and the weekly stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weekloom.constants import MODEL_FEATURES, WEEKLY_CLIMATE
from weekloom.operators import blend, ensemble, explain, learn, seasonal, weekly
from weekloom.operators.joins import keep_last
from weekloom.plans import serving
from weekloom.registry.base import out, query, show
from weekloom.registry.quality import SEASONAL
from weekloom.registry.sql import climate_agg, view
from weekloom.runtime import new_folder
from weekloom.streaming import weekly as stream

KEY = ["disease", "district", "week_start"]
KEEP = [*KEY, "split", "target"]
FEATURES = list(MODEL_FEATURES)
PAIRS = 2  # antithetic pairs of feature orders per explained row


# ---- blending ----------------------------------------------------------------------------------

@query("residual_interval", view("forecasts", """
SELECT disease, district, week_start, round(greatest(b + coalesce(lo, 0), 0), 6) AS lower, round(greatest(b + coalesce(hi, 0), 0), 6) AS upper
FROM forecasts LEFT JOIN (SELECT disease, district, quantile_cont(target - b, 0.05) AS lo, quantile_cont(target - b, 0.95) AS hi
  FROM forecasts WHERE split = 'val' GROUP BY ALL) USING (disease, district)"""))
def residual_interval(v):
    return show(learn.residual_interval(v.forecasts, p="b"), KEY, ["lower", "upper"])


@query("blend_apply", view("forecasts", """
SELECT disease, district, week_start, round(greatest(a * 0.3 + b * 0.7, 0), 6) AS median, round(greatest(a * 0.15 + b * 0.28, 0), 6) AS lower,
  round(greatest(a * 0.6 + b * 1.05, 0), 6) AS upper FROM forecasts"""))
def blend_apply(v):
    from weekloom.functions.numbers import blend as mix

    a, b = F.col("a"), F.col("b")
    df = v.forecasts.withColumns({"median": mix(a, b, 0.3), "lower": mix(a * 0.5, b * 0.4, 0.3), "upper": mix(a * 2.0, b * 1.5, 0.3)})
    return show(df, KEY, ["median", "lower", "upper"])


@query("blend_grid", view("forecasts", """
SELECT disease, CAST(arg_min(k, (round(mae, 9), k)) AS INTEGER) AS step, round(min(mae), 6) AS mae FROM (
  SELECT disease, k, avg(abs(target - greatest(a * (k / 50.0) + b * (1 - k / 50.0), 0))) AS mae
  FROM forecasts, (SELECT unnest(range(51)) AS k) WHERE split = 'val' GROUP BY ALL) GROUP BY disease"""))
def blend_grid(v):
    return show(blend.best_weight(v.forecasts.filter("split = 'val'"), ["disease"], 50), ["disease", "step"], ["mae"])


@query("blend_grid_r2", view("forecasts", """
SELECT disease, CAST(k AS INTEGER) AS step, round(r2, 6) AS r2, r2 >= 0.7 AS kept FROM (
  SELECT disease, k, 1 - sum((target - p * f) ** 2) / (count(*) * var_pop(target)) AS r2 FROM (
    SELECT x.disease, x.k, target, p, f FROM x JOIN (
      SELECT disease, district, k, greatest(0.3, least(4.0, quantile_cont(CASE WHEN p > 0.5 THEN target / p ELSE 1.0 END, 0.5))) AS f FROM x GROUP BY ALL) q
    ON x.disease = q.disease AND x.district = q.district AND x.k = q.k) GROUP BY ALL)""",
    {"x": "SELECT disease, district, k, target, greatest(a * (k / 6.0) + b * (1 - k / 6.0), 0) AS p FROM forecasts, (SELECT unnest(range(7)) AS k) WHERE split = 'val'"}))
def blend_grid_r2(v):
    df = blend.r2_by_weight(v.forecasts.filter("split = 'val'"), ["disease"], ["district"], 6)
    return show(df.withColumn("kept", F.col("r2") >= 0.7), ["disease", "step", "kept"], ["r2"])


@query("blend_closed_form", view("forecasts", """
SELECT disease, round(w, 6) AS weight_a, round(1 - w, 6) AS weight_b FROM (
  SELECT disease, greatest(0.01, least(0.99, coalesce(sum((target - b) * (a - b)) / nullif(sum((a - b) * (a - b)), 0), 0.5))) AS w
  FROM forecasts WHERE split = 'val' GROUP BY disease)"""))
def blend_closed_form(v):
    return show(blend.closed_form_weight(v.forecasts.filter("split = 'val'"), ["disease"]), ["disease"], ["weight_a", "weight_b"])


@query("ar1_baseline", view("series", """
SELECT disease, district, week_start, round(greatest(p, 0), 5) AS p, round(greatest(p - 1.96 * g, 0), 5) AS lower, round(greatest(p + 1.96 * g, 0), 5) AS upper FROM (
  SELECT s.disease, s.district, week_start, pow(b, h) * last + a * (1 - pow(b, h)) / (1 - b) AS p,
    sqrt(greatest(s2 * (1 - pow(b, 2 * h)) / (1 - b * b), 0)) AS g
  FROM (SELECT series.*, week_index - (SELECT max(week_index) FROM series WHERE split = 'train') AS h FROM series WHERE split <> 'train') s
  JOIN (SELECT disease, district, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, week_index) AS last,
          (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2) AS s2
        FROM (SELECT disease, district, week_index, CAST(target AS DOUBLE) AS y, CAST(lag(target) OVER (PARTITION BY disease, district ORDER BY week_index) AS DOUBLE) AS x
              FROM series WHERE split = 'train') GROUP BY ALL) f ON s.disease = f.disease AND s.district = f.district)"""))
def ar1_baseline(v):
    return show(learn.ar1_baseline(v.series), KEY, ["p", "lower", "upper"], digits=5)


@query("mean_std_fallback", view("series", """
SELECT disease, district, week_start, round(m, 6) AS p, round(greatest(m - 1.96 * sd, 0), 6) AS lower, round(m + 1.96 * sd, 6) AS upper FROM series
JOIN (SELECT disease, avg(target) AS m, stddev_pop(target) AS sd FROM series WHERE split = 'train' GROUP BY disease) USING (disease) WHERE split <> 'train'"""))
def mean_std_fallback(v):
    return show(learn.mean_std_fallback(v.kept_series), KEY, ["p", "lower", "upper"])


def _contributions(v, disease=None, district=None, week=None):
    """Contributions of a week's forecasts (by default the newest) of all or one disease and area."""
    store, table = v.learned("boosted"), v.model_table
    day = F.to_date(F.lit(week)) if week else table.agg(F.max("week_start")).scalar()
    rows = table.filter(F.col("week_start") == day)
    if district:
        rows = rows.filter(F.col("district") == district)
    out = None
    for name in [disease] if disease else sorted(ensemble.SETTINGS):
        own = F.col("disease") == name
        reference = explain.background(table.filter(own).filter("split = 'train'"), PAIRS)
        part = explain.shapley(store.load(name, "boosted"), rows.filter(own), reference, FEATURES, KEY, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


# ---- learners ----------------------------------------------------------------------------------

@query("assemble", view("features", "SELECT disease, district, week_start, CAST(80 AS INTEGER) AS width, round("
    + " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in FEATURES) + ", 4) AS total FROM features"))
def assemble(v):
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    df = learn.assemble(v.features, FEATURES, KEEP)
    return df.select(*KEY, F.size(x).alias("width"), F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


def _held_out(v, fit):
    """Held-out predictions of ``fit(rows, disease)`` per disease."""
    models = ensemble.fit_each(v.model_table, fit)
    return show(ensemble.scored_each(v.model_table.filter("split <> 'train'"), models, KEEP), KEEP, ["p"])


@query("boosted_point")
def boosted_point(v):
    return show(ensemble.predicted(v.model_table.filter("split <> 'train'"), v.learned("boosted"), "boosted", KEEP), KEEP, ["p"])


@query("second_learner")
def second_learner(v):
    return show(ensemble.predicted(v.model_table.filter("split <> 'train'"), v.learned("forest"), "forest", KEEP), KEEP, ["p"])


@query("quantile_leaf")
def quantile_leaf(v):
    quantiles = ensemble.forest_intervals(v.model_table, v.learned("forest"), KEY, {"lower": 0.05, "median": 0.5, "upper": 0.95})
    rows = v.model_table.filter("split <> 'train'").select(*KEEP)
    return show(rows.join(quantiles, KEY, "left"), KEEP, ["lower", "median", "upper"])


@query("ridge_baseline")
def ridge_baseline(v):
    return _held_out(v, lambda rows, _: learn.ridge(rows.filter("split = 'train'")))


@query("tree_baseline")
def tree_baseline(v):
    return _held_out(v, lambda rows, _: learn.tree(rows.filter("split = 'train'")))


@query("poisson_model")
def poisson_model(v):
    return _held_out(v, lambda rows, _: learn.poisson(rows.filter("split = 'train'")))


@query("learning_curve")
def learning_curve(v):
    """Every round that was tried, both learners, with the lowest error and the round that is served."""
    store = v.learned(*ensemble.LEARNERS)
    curves = [ensemble.staged_errors(v.model_table, store, p, KEY) for p in ensemble.LEARNERS]
    return show(curves[0].unionByName(curves[1]), ["disease", "learner", "split", "round", "best", "stop"], ["mae", "rmse"])


@query("tree_importance")
def tree_importance(v):
    """Gains of each disease's boosted learner."""
    store = v.learned("boosted")
    gains = [(d, f, g) for d in sorted(ensemble.SETTINGS) for f, g in zip(FEATURES, store.load(d, "boosted").featureImportances.toArray().tolist())]
    return show(v.spark.createDataFrame(gains, "disease string, feature string, gain double"), ["disease", "feature"], ["gain"])


@query("topk_importance")
def topk_importance(v):
    """Refit of each disease on the features its boosted learner ranks highest (three tenths are dropped, ten at least stay)."""
    store = v.learned("boosted")
    tops = {d: learn.top_places(store.load(d, "boosted").featureImportances.toArray().tolist(), FEATURES, 0.3) for d in ensemble.SETTINGS}
    slim = learn.sliced(v.model_table, tops)
    models = ensemble.fit_each(slim, lambda rows, d: ensemble.fit_boosted(rows, ensemble.SETTINGS[d])["boosted"])
    return show(ensemble.scored_each(slim.filter("split <> 'train'"), models, KEEP), KEEP, ["p"])


@query("permutation_importance")
def permutation_importance(v):
    """Rise of the test MAE of each disease's boosted learner when a feature is shuffled, all features."""
    store, test = v.learned("boosted"), v.model_table.filter("split = 'test'")
    out = None
    for d in sorted(ensemble.SETTINGS):
        part = explain.permutation_importance(store.load(d, "boosted"), test.filter(F.col("disease") == d), FEATURES, FEATURES, KEY).withColumn("disease", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return show(out, ["disease", "feature"], ["rise"])


@query("local_contribution")
def local_contribution(v):
    """All features of every forecast of the newest week, with the base value: base + contributions = forecast."""
    return show(_contributions(v), [*KEY, "feature"], ["base", "forecast", "contribution"])


@query("explain")
def explain_rows(v):
    """Why one area's forecasts of a week: all features of each disease, by size."""
    parts = _contributions(v, district="NATION_1").withColumn("place", F.row_number().over(
        Window.partitionBy(*KEY).orderBy(F.desc(F.abs("contribution")), "feature")))
    return show(parts, [*KEY, "feature", "place"], ["base", "forecast", "contribution"])


@query("config_search")
def config_search(v):
    """The eight named sets per disease by successive halving on val: rounds of the best error, stage, winner."""
    rows = ensemble.named_search(v.model_table)
    df = v.spark.createDataFrame(rows, "disease string, config string, rounds int, mae_val double, stage int, best boolean")
    return show(df, ["disease", "config", "rounds", "stage", "best"], ["mae_val"])


@query("per_disease_fit")
def per_disease_fit(v):
    """The ensemble chain of every disease: learners on all features, blend and area bias from val."""
    return show(v.blended, KEEP, ["a", "b", "weight", "factor", "lower", "median", "upper"])


@query("ensemble_metrics")
def ensemble_metrics(v):
    """Test errors of the chain and of its learners, with the rounds that were fitted."""
    rounds = v.learned(*ensemble.LEARNERS).manifest().filter("part = 'boosted'").select(F.col("key").alias("disease"), F.col("facts")["rounds"].alias("rounds"))
    scores = ensemble.metrics(v.blended).join(rounds, "disease")
    return show(scores, ["disease"], [c for c in scores.columns if c not in ("disease", "n", "rounds")], ["n", "rounds"])


# ---- serving -----------------------------------------------------------------------------------

@query("list_diseases", view("series", "SELECT DISTINCT disease FROM series"))
def list_diseases(v):
    return serving.list_values(v.series, "disease")


@query("list_districts", view("series", "SELECT DISTINCT district FROM series"))
def list_districts(v):
    return serving.list_values(v.series, "district")


@query("past_cases", view("series", """
SELECT district, week_start, CAST(week_start + 6 AS DATE) AS week_end, target AS cases FROM series
WHERE disease = 'chickenpox' AND district IN ('NATION_3', 'NATION_4') AND week_start >= DATE '1997-03-03'"""))
def past_cases(v):
    return serving.past_cases(v.series, "chickenpox", "NATION_3, NATION_4", "1997-03-03")


@query("cases_in_week", view("series", "SELECT disease, CAST(sum(target) AS BIGINT) AS cases FROM series WHERE week_start = DATE '1999-06-07' GROUP BY disease"))
def cases_in_week(v):
    return serving.cases_in_week(v.series, F.lit("1999-06-07").cast("date"))


def _past4_sql(by):
    g = ", ".join(by)
    return f"""SELECT {g}, week_start, CAST(sum(target) AS DOUBLE) AS cases, 'actual' AS kind FROM forecasts
WHERE week_start < DATE '2001-06-04' AND week_start >= DATE '2001-06-04' - 28 GROUP BY {g}, week_start
UNION ALL SELECT {g}, week_start, round(sum(b), 6), 'predicted' FROM forecasts WHERE week_start = DATE '2001-06-04' GROUP BY {g}, week_start"""


@query("past_4_weeks", view("forecasts", "SELECT disease, district, week_start, cases, kind FROM (" + _past4_sql(["disease", "district"])
    + ") UNION ALL SELECT disease, 'country', week_start, cases, kind FROM (" + _past4_sql(["disease"]) + ")"))
def past_4_weeks(v):
    week = F.lit("2001-06-04").cast("date")
    f = v.forecasts
    each = serving.past_weeks_and_forecast(f, f, week, ["disease", "district"], value="b")
    country = serving.past_weeks_and_forecast(f, f, week, ["disease"], value="b").withColumn("district", F.lit("country"))
    return show(each.unionByName(country), ["disease", "district", "week_start", "kind"], ["cases"])


_PAYLOAD = ["target_lag_1", "target_lag_12", "target_roll_mean_4", "target_roll_std_8", "T2M_avg_lag_1", "district_week_mean", "late_dist_mean", "ratio_to_seasonal"]


@query("prediction_payload", view("features", f"SELECT {out(KEY, _PAYLOAD)} FROM features WHERE week_start = (SELECT max(week_start) FROM features)"))
def prediction_payload(v):
    panel = v.kept_panel
    newest = panel.agg(F.max("week_start")).scalar()
    week = panel.filter(F.col("week_start") == newest).withColumn("target", F.lit(None).cast("bigint"))
    return show(serving.prediction_payload(panel, week, v.codes), KEY, _PAYLOAD)


NORMALISED = ["chickenpox"]  # diseases whose learners forecast what is left above season and trend


def _intervals(v):
    f = v.kept_forecasts
    back = F.when(F.col("disease").isin(NORMALISED), F.col("seasonal_mean") + F.col("trend")).otherwise(0.0)
    rest = seasonal.seasonal_normalise(f).withColumn("back", back).withColumns({"a": F.col("a") - F.col("back"), "b": F.col("b") - F.col("back")})
    both = rest.withColumns({
        "a_lower": F.expr("a * 0.5"), "a_median": F.col("a"), "a_upper": F.expr("a * 1.5 + 0.2"),
        "b_lower": F.expr("b * 0.6"), "b_median": F.col("b"), "b_upper": F.expr("b * 1.4 + 0.1")})
    factors = blend.district_bias(f.filter("split = 'val'"), p="b")
    return serving.predict_interval(both.filter("split = 'test'"), factors, 0.3, "back")


_INTERVAL = {**SEASONAL, "nf": """SELECT f.* REPLACE (a - back AS a, b - back AS b) FROM (
  SELECT f.*, CASE WHEN f.disease = 'chickenpox' THEN r.seasonal_mean + l.intercept + l.slope * f.week_index ELSE 0 END AS back FROM forecasts f
  JOIN res r ON f.disease = r.disease AND f.district = r.district AND f.week_start = r.week_start JOIN line l ON f.disease = l.disease) f""",
"iv": """SELECT disease, district, week_start, least(l, m) AS lower, m AS median, greatest(u, m) AS upper FROM (
  SELECT f.disease, f.district, week_start, greatest(greatest(a * 0.5 * 0.3 + b * 0.6 * 0.7, 0) + back, 0) * coalesce(k, 1) AS l,
    greatest(greatest(a * 0.3 + b * 0.7, 0) + back, 0) * coalesce(k, 1) AS m,
    greatest(greatest((a * 1.5 + 0.2) * 0.3 + (b * 1.4 + 0.1) * 0.7, 0) + back, 0) * coalesce(k, 1) AS u
  FROM nf f LEFT JOIN (SELECT disease, district, greatest(0.3, least(4.0, quantile_cont(CASE WHEN b > 0.5 THEN target / b ELSE 1.0 END, 0.5))) AS k
    FROM forecasts WHERE split = 'val' GROUP BY ALL) q ON f.disease = q.disease AND f.district = q.district WHERE split = 'test')"""}


@query("predict_interval", view(("series", "forecasts"), f"SELECT {out(KEY, ['lower', 'median', 'upper'])} FROM iv", _INTERVAL))
def predict_interval(v):
    return show(_intervals(v), KEY, ["lower", "median", "upper"])


@query("predict_totals", view(("series", "forecasts"), """
SELECT disease, week_start, round(sum(lower), 6) AS lower, round(sum(median), 6) AS median, round(sum(upper), 6) AS upper, CAST(count(*) AS BIGINT) AS districts,
  strftime(week_start, '%Y-%m-%d') || ' to ' || strftime(CAST(week_start + 6 AS DATE), '%Y-%m-%d') AS week_range FROM iv GROUP BY ALL""", _INTERVAL))
def predict_totals(v):
    return show(serving.predict_totals(_intervals(v)), ["disease", "week_start", "districts", "week_range"], ["lower", "median", "upper"])


@query("planning_total", view(("series", "forecasts"), """
SELECT disease, week_start, CAST(sum(round_even(CASE WHEN median - lower > 0 THEN median - 0.5 * (median - lower) ELSE lower END, 0)) AS BIGINT) AS total_low,
  CAST(sum(round_even(CASE WHEN upper - median > 0 THEN median + 0.5 * (upper - median) ELSE upper END, 0)) AS BIGINT) AS total_high,
  round(sum(median), 6) AS total_median FROM iv GROUP BY ALL""", _INTERVAL))
def planning_total(v):
    return show(serving.planning_total(_intervals(v)), ["disease", "week_start", "total_low", "total_high"], ["total_median"])


@query("feature_importance", view("series", """
SELECT district AS feature, CASE WHEN sum(target) % 7 = 0 THEN 0.0 ELSE round(sum(target) / 3.0, 4) END AS importance FROM series GROUP BY district"""))
def feature_importance(v):
    total = v.series.groupBy("district").agg(F.sum("target").alias("t"))
    raw = total.select(F.concat(F.lit(" "), "district", F.lit(" ")).alias("feature"),
                       F.when(F.col("t") % 7 == 0, "n/a").otherwise((F.col("t") / 3.0).cast("string")).alias("value"))
    return serving.feature_importance(raw)


_ROW = ["T2M_avg", "RH2M_avg", "PRECTOTCORR_avg"]
_WEEK_SQL = {"rw": f"SELECT district, CAST(date_trunc('week', ts) AS DATE) AS week_start, {climate_agg()} FROM readings GROUP BY 1, 2"}


@query("weekly_feature_row", view("readings", "SELECT c.district, c.week_start, " + ", ".join(f"round(c.{c}, 6) AS {c}" for c in WEEKLY_CLIMATE) + """,
  CAST(month(c.week_start) AS BIGINT) AS month, CAST(weekofyear(c.week_start) AS BIGINT) AS week_number, round(sin(2 * pi() * weekofyear(c.week_start) / 52), 6) AS sin_week,
  strftime(c.week_start, '%Y-%m-%d') || ' to ' || strftime(CAST(c.week_start + 6 AS DATE), '%Y-%m-%d') AS duration, """ + ", ".join(
    f"CASE WHEN {' AND '.join(f'w{i}.district IS NOT NULL' for i in range(1, 7))} THEN round(w{k}.{c}, 6) END AS {c}_lag_{k}" for c in _ROW for k in range(1, 7))
    + " FROM rw c " + " ".join(f"LEFT JOIN hist w{k} ON w{k}.district = c.district AND w{k}.week_start = c.week_start - {7 * k}" for k in range(1, 7)),
    {**_WEEK_SQL, "hist": f"SELECT district, CAST(week_start + 7 * s AS DATE) AS week_start, {', '.join(f'{c} + s AS {c}' for c in _ROW)} FROM rw, (SELECT unnest([-4, 0]) AS s) WHERE s = 0 OR week_start >= DATE '2024-01-08' QUALIFY row_number() OVER (PARTITION BY district, CAST(week_start + 7 * s AS DATE) ORDER BY s DESC) = 1"}))
def weekly_feature_row(v):
    day = lambda s: F.lit(s).cast("date")
    base = weekly.weekly_climate(v.readings, "ts")
    older = base.filter("week_start >= DATE'2024-01-08'").select(
        "district", F.date_sub("week_start", 28).alias("week_start"), *[(F.col(c) - 4).alias(c) for c in _ROW])
    # History: the weeks themselves plus a copy four weeks earlier, so that six lag weeks exist for the later ones.
    history = keep_last(base.select("district", "week_start", *_ROW).withColumn("_r", F.lit(1)).unionByName(older.withColumn("_r", F.lit(0))),
                        ["district", "week_start"], "_r")
    df = serving.weekly_feature_row(v.readings, day("2023-12-01"), day("2024-12-31"), history, _ROW)
    lags = [f"{c}_lag_{k}" for c in _ROW for k in range(1, 7)]
    return show(df, ["district", "week_start", "duration"], [*WEEKLY_CLIMATE, "sin_week", *lags], ["month", "week_number"])


# ---- streaming ---------------------------------------------------------------------------------

@query("stream_weekly_climate", view("readings", f"""
SELECT {out(['district', 'week_start'], list(WEEKLY_CLIMATE))} FROM (SELECT district, CAST(date_trunc('week', ts) AS DATE) AS week_start, {climate_agg()} FROM readings GROUP BY 1, 2)"""))
def stream_weekly_climate(v):
    from weekloom.plans.views import readings_of

    path, state = new_folder(v.spark, "weeks"), new_folder(v.spark, "state")
    source = v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.folder}/event[s].parquet")
    stream.run_to_table(readings_of(source), path, state)
    return show(stream.read_table(v.spark, path), ["district", "week_start"], WEEKLY_CLIMATE)
