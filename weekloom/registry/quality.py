"""Queries over forecast quality, drift, weights and seasonal baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import blend, drift, evaluate, seasonal
from weekloom.registry.base import out, query, show
from weekloom.registry.sql import view

KEY = ["disease", "district", "week_start"]

_ERR = """round(avg(abs(target - {p})), 6) AS mae, round(sqrt(avg((target - {p}) * (target - {p}))), 6) AS rmse,
  round(1 - sum((target - {p}) * (target - {p})) / (count(*) * var_pop(target)), 6) AS r2"""


@query("regression_metrics", view("forecasts", f"SELECT disease, split, {_ERR.format(p='a')}, CAST(count(*) AS BIGINT) AS n FROM forecasts GROUP BY ALL"))
def regression_metrics(v):
    return show(evaluate.regression_metrics(v.forecasts, ["disease", "split"], p="a"), ["disease", "split", "n"], ["mae", "rmse", "r2"])


@query("interval_metrics", view("forecasts", """
SELECT disease, split, round(avg(CASE WHEN target BETWEEN a * 0.5 AND a * 1.5 + 0.25 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(avg((a * 1.5 + 0.25) - a * 0.5), 6) AS width FROM forecasts GROUP BY ALL"""))
def interval_metrics(v):
    df = v.forecasts.withColumns({"lower": F.expr("a * 0.5"), "upper": F.expr("a * 1.5 + 0.25")})
    return show(evaluate.interval_metrics(df, ["disease", "split"]), ["disease", "split"], ["coverage", "width"])


@query("baseline_compare", view("forecasts", """
SELECT disease, round(mae, 6) AS mae, round(mae_mean, 6) AS mae_mean, round(mae_median, 6) AS mae_median, round((mae_mean - mae) / mae_mean * 100, 6) AS gain_pct
FROM (SELECT f.disease, avg(abs(target - b)) AS mae, avg(abs(target - m)) AS mae_mean, avg(abs(target - md)) AS mae_median
  FROM forecasts f JOIN (SELECT disease, avg(target) AS m, quantile_cont(target, 0.5) AS md FROM forecasts WHERE split = 'train' GROUP BY disease) t ON f.disease = t.disease
  WHERE split = 'test' GROUP BY f.disease)"""))
def baseline_compare(v):
    return show(evaluate.baseline_compare(v.kept_forecasts, ["disease"], p="b"), ["disease"], ["mae", "mae_mean", "mae_median", "gain_pct"])


@query("district_mae", view("forecasts", "SELECT disease, district, round(avg(abs(target - a)), 6) AS mae FROM forecasts WHERE split = 'test' GROUP BY ALL"))
def district_mae(v):
    df = v.forecasts.filter("split = 'test'").groupBy("disease", "district").agg(F.avg(F.abs(F.expr("target - a"))).alias("mae"))
    return show(df, ["disease", "district"], ["mae"]).orderBy("disease", "mae", "district")


@query("weekly_actual_vs_pred", view("forecasts", """
SELECT disease, week_start, CAST(sum(target) AS BIGINT) AS actual, round(sum(b), 6) AS predicted, round(sum(target) - sum(b), 6) AS residual,
  CASE WHEN round(sum(target) - sum(b), 9) > 0 THEN 'under' WHEN round(sum(target) - sum(b), 9) < 0 THEN 'over' ELSE 'exact' END AS side FROM forecasts GROUP BY ALL"""))
def weekly_actual_vs_pred(v):
    df = v.forecasts.groupBy("disease", "week_start").agg(F.sum("target").alias("actual"), F.sum("b").alias("predicted"))
    df = df.withColumn("residual", F.col("actual") - F.col("predicted"))
    r = F.round("residual", 9)
    df = df.withColumn("side", F.when(r > 0, "under").when(r < 0, "over").otherwise("exact"))
    return show(df, ["disease", "week_start", "side"], ["predicted", "residual"], ["actual"])


_BIAS = """SELECT disease, district, greatest(0.3, least(4.0, quantile_cont(CASE WHEN {p} > 0.5 THEN target / {p} ELSE 1.0 END, 0.5))) AS factor
FROM forecasts WHERE split = 'val' GROUP BY ALL"""


@query("district_bias", view("forecasts", f"SELECT disease, district, round(factor, 6) AS factor FROM ({_BIAS.format(p='b')})"))
def district_bias(v):
    return show(blend.district_bias(v.forecasts.filter("split = 'val'"), p="b"), ["disease", "district"], ["factor"])


@query("seasonal_baseline", view("series", """
SELECT 'district_week' AS level, disease, district, week_number, round(avg(target), 6) AS mean FROM series WHERE split = 'train' GROUP BY ALL
UNION ALL SELECT 'week', disease, NULL, week_number, round(avg(target), 6) FROM series WHERE split = 'train' GROUP BY disease, week_number
UNION ALL SELECT 'global', disease, NULL, NULL, round(avg(target), 6) FROM series WHERE split = 'train' GROUP BY disease
UNION ALL SELECT 'fallback', disease, NULL, NULL, round(avg(m), 6) FROM (SELECT disease, avg(target) AS m FROM series WHERE split = 'train' GROUP BY disease, week_number) GROUP BY disease"""))
def seasonal_baseline(v):
    return show(seasonal.seasonal_baseline(v.series.filter("split = 'train'")), ["level", "disease", "district"], ["mean"], ["week_number"])


@query("late_mean", view("series", """
SELECT disease, district, round(avg(target), 6) AS late_mean FROM series WHERE split = 'train'
  AND week_index >= (SELECT max(week_index) - 52 FROM series WHERE split = 'train') GROUP BY ALL"""))
def late_mean(v):
    return show(seasonal.late_mean(v.series.filter("split = 'train'")), ["disease", "district"], ["late_mean"])


SEASONAL = {
    "res": """SELECT s.*, coalesce(f.m, c.m, r.m) AS seasonal_mean
FROM series s LEFT JOIN (SELECT disease, avg(m) AS m FROM (SELECT disease, avg(target) AS m FROM series WHERE split = 'train' GROUP BY disease, week_number) GROUP BY disease) r
  ON s.disease = r.disease LEFT JOIN (SELECT disease, district, week_number, avg(target) AS m FROM series WHERE split = 'train' GROUP BY ALL) f
  ON s.disease = f.disease AND s.district = f.district AND s.week_number = f.week_number
LEFT JOIN (SELECT disease, week_number, avg(target) AS m FROM series WHERE split = 'train' GROUP BY ALL) c ON s.disease = c.disease AND s.week_number = c.week_number""",
    "line": """SELECT disease, regr_slope(target - seasonal_mean, week_index) AS slope, regr_intercept(target - seasonal_mean, week_index) AS intercept
FROM res WHERE split = 'train' GROUP BY disease""",
}


@query("linear_trend", view("series", "SELECT disease, round(slope, 9) AS slope, round(intercept, 6) AS intercept FROM line", SEASONAL))
def linear_trend(v):
    rows = seasonal.with_seasonal_mean(v.kept_series).filter("split = 'train'")
    df = seasonal.linear_trend(rows.withColumn("residual", F.col("target") - F.col("seasonal_mean")))
    return df.select("disease", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("seasonal_normalise", view("series", """
SELECT disease, district, week_start, round(seasonal_mean, 6) AS seasonal_mean, round(intercept + slope * week_index, 6) AS trend,
  round(target - seasonal_mean - (intercept + slope * week_index), 6) AS normalised, CAST(target AS DOUBLE) AS restored FROM res JOIN line USING (disease)""", SEASONAL))
def seasonal_normalise(v):
    df = seasonal.add_back(seasonal.seasonal_normalise(v.kept_series))
    return show(df, KEY, ["seasonal_mean", "trend", "normalised", "restored"])


_SHIFT = ["mean_train", "std_train", "mean_val", "std_val", "mean_test", "std_test", "shift_val", "shift_test"]


@query("shift_report", view("series", f"""
SELECT {out(['disease'], _SHIFT)}, greatest(shift_val, shift_test) > 0.3 AS severe FROM (
  SELECT *, abs(mean_val - mean_train) / abs(mean_train) AS shift_val, abs(mean_test - mean_train) / abs(mean_train) AS shift_test FROM (
  SELECT disease, {', '.join(f"{f}(target) FILTER (WHERE split = '{s}') AS {n}_{s}" for s in ('train', 'val', 'test') for f, n in (('avg', 'mean'), ('stddev_pop', 'std')))}
  FROM series GROUP BY disease))"""))
def shift_report(v):
    return show(drift.shift_report(v.series), ["disease", "severe"], _SHIFT)


def _ks_sql(source, by, value, pairs):
    names = sorted({s for p in pairs for s in p})
    b = ", ".join(by)
    counts = ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS n_{s}" for s in names)
    ecdf = ", ".join(f"sum(n_{s}) OVER (PARTITION BY {b} ORDER BY {value}) * 1.0 / sum(n_{s}) OVER (PARTITION BY {b}) AS f_{s}" for s in names)
    gaps = ", ".join(f"round(max(abs(f_{x} - f_{y})), 6) AS ks_{x}_{y}" for x, y in pairs)
    return f"SELECT {b}, {gaps} FROM (SELECT {b}, {ecdf} FROM (SELECT {b}, {value}, {counts} FROM {source} WHERE {value} IS NOT NULL GROUP BY {b}, {value})) GROUP BY {b}"


_PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


@query("ks_two_sample", view("series", _ks_sql("series", ["disease"], "target", _PAIRS)))
def ks_two_sample(v):
    return show(drift.ks_pairs(v.series, ["disease"], "target", "split", _PAIRS), ["disease"], [f"ks_{a}_{b}" for a, b in _PAIRS])


_SCREEN = ["target", "T2M_avg", "T2M_max", "T2M_min", "RH2M_avg", "PRECTOTCORR_avg", "week_number", "sin_week", "cos_week", "week_index"]


@query("leakage_screen", view("panel", "SELECT *, ks_train_val > 0.2 AND ks_val_test < 0.1 AS suspicious FROM ("
    + _ks_sql("tall", ["disease", "feature"], "value", [("train", "val"), ("val", "test")]) + ")",
    {"tall": " UNION ALL ".join(f"SELECT disease, split, '{c}' AS feature, round(CAST({c} AS DOUBLE), 9) AS value FROM panel" for c in _SCREEN)}))
def leakage_screen(v):
    # Rounded so that means summed in another order count as the same value on both engines.
    df = v.kept_panel.select("disease", "split", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in _SCREEN])
    return show(drift.leakage_screen(df, _SCREEN), ["disease", "feature", "suspicious"], ["ks_train_val", "ks_val_test"])


_T = {"t": "SELECT * FROM series"}
_ROW = "disease, district, week_start, target"
_D = "(PARTITION BY disease)"


@query("hist_reweight", view("series", f"""
SELECT {_ROW}, round(w / avg(w) OVER {_D}, 6) AS weight FROM (
  SELECT t.*, greatest(0.1, least(10.0, te / vs)) AS w FROM (SELECT t.*, {{bin}} AS bin FROM t JOIN sp USING (disease)) t JOIN (
    SELECT disease, bin, vn * 1.0 / sum(vn) OVER {_D} AS vs, en * 1.0 / sum(en) OVER {_D} AS te FROM (
      SELECT disease, {{bin}} AS bin, count(*) FILTER (WHERE split = 'val') AS vn, count(*) FILTER (WHERE split = 'test') AS en
      FROM t JOIN sp USING (disease) WHERE split IN ('val', 'test') GROUP BY 1, 2)) h USING (disease, bin) WHERE split = 'val')""".replace(
    "{bin}", "CAST(least(greatest(floor((target - lo) / (hi - lo) * 20), 0), 19) AS INTEGER)"),
    {**_T, "sp": "SELECT disease, CAST(min(target) AS DOUBLE) AS lo, max(target) + 1e-9 AS hi FROM t WHERE split IN ('val', 'test') GROUP BY disease"}))
def hist_reweight(v):
    return show(drift.hist_reweight(v.kept_series), KEY, ["weight"], ["target"])


def _edges(source, n):
    return "SELECT disease, [" + ", ".join(f"quantile_cont(target, {i / n})" for i in range(n)) + f", max(target) + 1e-6] AS e FROM {source} GROUP BY disease"


def _bin(n):
    return f"least(greatest(len(list_filter(e, lambda x: x <= target)) - 1, 0), {n - 1})"


_TRAIN = {**_T, "tr": "SELECT * FROM t WHERE split = 'train'"}


@query("decile_weights", view("series", f"""
SELECT {_ROW}, round(w / avg(w) OVER {_D}, 6) AS weight FROM (
  SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY disease, bin)) AS w FROM (SELECT *, {_bin(10)} AS bin FROM tr JOIN ed USING (disease)))""", {**_TRAIN, "ed": _edges("tr", 10)}))
def decile_weights(v):
    return show(drift.inverse_root_weights(v.kept_series), KEY, ["weight"], ["target"])


_VBIN = "CAST(least(greatest(floor((target - lo) / (hi - lo) * 20), 0), 19) AS INTEGER)"


@query("blend_weights_20_80", view("series", f"""
SELECT {_ROW}, round(c / avg(c) OVER {_D}, 6) AS weight FROM (SELECT *, 0.8 * f / avg(f) OVER {_D} + 0.2 * d / avg(d) OVER {_D} AS c FROM (
  SELECT t.*, 1 / sqrt(count(*) OVER (PARTITION BY disease, qbin)) AS f, greatest(0.2, least(5.0, coalesce(r, 1.0))) AS d
  FROM (SELECT tr.*, {_bin(20)} AS qbin, {_VBIN} AS hbin FROM tr JOIN ed USING (disease) JOIN sp USING (disease)) t LEFT JOIN h USING (disease, hbin)))""", {
    **_TRAIN, "ed": _edges("tr", 20),
    "sp": "SELECT disease, CAST(min(target) AS DOUBLE) AS lo, CAST(max(target) AS DOUBLE) AS hi FROM t WHERE split = 'val' GROUP BY disease",
    "hc": f"SELECT disease, {_VBIN} AS hbin, count(*) FILTER (WHERE split = 'train') AS tn, count(*) FILTER (WHERE split = 'val') AS vn FROM t JOIN sp USING (disease) WHERE split IN ('train', 'val') AND target BETWEEN lo AND hi GROUP BY 1, 2",
    "h": f"SELECT disease, hbin, (vn * 1.0 / sum(vn) OVER {_D}) / (nullif(tn, 0) * 1.0 / sum(tn) OVER {_D}) AS r FROM hc"}))
def blend_weights_20_80(v):
    return show(drift.blend_weights_20_80(v.kept_series), KEY, ["weight"], ["target"])


@query("align_weights", view("series", f"""
SELECT {_ROW}, round(w / (avg(w) OVER {_D} + 1e-9), 6) AS weight FROM (SELECT b.*, (en * 1.0 / et) / (tn * 1.0 / tt) AS w
  FROM b JOIN c USING (disease, bin) JOIN (SELECT disease, sum(tn) + 10 - count(*) AS tt, sum(en) AS et FROM c GROUP BY disease) USING (disease) WHERE split = 'train')""", {
    **_T, "two": "SELECT * FROM t WHERE split IN ('train', 'test')", "ed": _edges("two", 10), "b": f"SELECT two.*, {_bin(10)} AS bin FROM two JOIN ed USING (disease)",
    "c": "SELECT disease, bin, greatest(count(*) FILTER (WHERE split = 'train'), 1) AS tn, count(*) FILTER (WHERE split = 'test') AS en FROM b GROUP BY disease, bin"}))
def align_weights(v):
    return show(drift.align_weights(v.kept_series), KEY, ["weight"], ["target"])


@query("zero_align_weights", view("series", f"""
SELECT {_ROW}, round(w / avg(w) OVER {_D}, 6) AS weight FROM (
  SELECT t.*, greatest(0.3, least(4.0, CASE WHEN target = 0 THEN g / z ELSE (1 - g) / greatest(1 - z, 1e-6) END)) AS w FROM t JOIN
   (SELECT disease, greatest(avg(CASE WHEN target = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'train'), 1e-6) AS z,
      greatest((avg(CASE WHEN target = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'val') + avg(CASE WHEN target = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'test')) / 2, 1e-6) AS g
    FROM t GROUP BY disease) USING (disease) WHERE split = 'train')""", _T))
def zero_align_weights(v):
    return show(drift.zero_align_weights(v.kept_series), KEY, ["weight"], ["target"])


@query("minmax_percentile", view("forecasts", """
SELECT disease, district, week_start, round(greatest(0, least(1, (b - lo) / g)), 6) AS scaled, round(greatest(0, least(1, (b - lo) / g)) * g + lo, 6) AS restored
FROM forecasts JOIN (SELECT disease, quantile_cont(b, 0.005) AS lo, greatest(quantile_cont(b, 0.995) - quantile_cont(b, 0.005), 1e-6) AS g
  FROM forecasts WHERE split = 'train' GROUP BY disease) USING (disease)"""))
def minmax_percentile(v):
    return show(drift.minmax_percentile(v.kept_forecasts, "b"), KEY, ["scaled", "restored"])


_STD = ["T2M_avg", "RH2M_avg", "target"]


@query("standardise", view("panel", "SELECT disease, district, week_start, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_z" for c in _STD)
    + " FROM panel JOIN (SELECT disease, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _STD)
    + " FROM panel WHERE split = 'train' GROUP BY disease) USING (disease)"))
def standardise(v):
    return show(drift.standardise(v.kept_panel, _STD), KEY, [f"{c}_z" for c in _STD])


_MODELS = ["recent", "seasonal", "blended"]


def _scores(v):
    f = v.forecasts.filter("split = 'test'").select(
        "disease", "target", F.col("a").alias("recent"), F.col("b").alias("seasonal"), F.expr("a * 0.5 + b * 0.5").alias("blended"))
    return evaluate.regression_metrics(evaluate.melt_models(f, ["disease", "target"], _MODELS), ["disease", "model"])


_SCORE = {"sc": " UNION ALL ".join(f"""SELECT disease, '{m}' AS model, avg(abs(target - ({p}))) AS mae, sqrt(avg((target - ({p})) ** 2)) AS rmse,
  1 - sum((target - ({p})) ** 2) / (count(*) * var_pop(target)) AS r2, count(*) AS n FROM forecasts WHERE split = 'test' GROUP BY disease"""
    for m, p in (("recent", "a"), ("seasonal", "b"), ("blended", "a * 0.5 + b * 0.5")))}
_SCORE["wide"] = "SELECT disease, " + ", ".join(f"max({x}) FILTER (WHERE model = '{m}') AS {m}_{x}" for m in _MODELS for x in ("mae", "rmse", "r2")) + " FROM sc GROUP BY disease"
_WIDE = [f"{m}_{x}" for m in _MODELS for x in ("mae", "rmse", "r2")]


@query("model_comparison", view("forecasts", f"SELECT {out(['disease'], _WIDE)} FROM wide", _SCORE))
def model_comparison(v):
    return show(evaluate.model_comparison(_scores(v), _MODELS), ["disease"], _WIDE)


@query("model_ranking", view("forecasts", """
SELECT disease, arg_min(model, (round(mae, 9), model)) AS best_mae, arg_min(model, (round(rmse, 9), model)) AS best_rmse,
  arg_min(model, (round(-r2, 9), model)) AS best_r2 FROM sc GROUP BY disease""", _SCORE))
def model_ranking(v):
    return evaluate.model_ranking(_scores(v))


@query("mae_improvement", view("forecasts", """
SELECT round(avg((recent_mae - seasonal_mae) / recent_mae * 100), 6) AS seasonal_gain_pct, round(avg((recent_mae - blended_mae) / recent_mae * 100), 6) AS blended_gain_pct FROM wide""", _SCORE))
def mae_improvement(v):
    df = evaluate.mae_improvement(evaluate.model_comparison(_scores(v), _MODELS), "recent", ["seasonal", "blended"])
    return show(df, (), ["seasonal_gain_pct", "blended_gain_pct"])


@query("normalised_mae", view("forecasts", "SELECT disease, " + ", ".join(
    f"round({m}_mae / greatest(recent_mae, seasonal_mae, blended_mae), 6) AS {m}" for m in _MODELS) + " FROM wide", _SCORE))
def normalised_mae(v):
    return show(evaluate.normalised_mae(evaluate.model_comparison(_scores(v), _MODELS), _MODELS), ["disease"], _MODELS)


@query("best_iteration", view("forecasts", """
SELECT disease, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY disease ORDER BY round(-r2, 9), model) AS rn FROM sc) WHERE rn = 1""", _SCORE))
def best_iteration(v):
    return show(evaluate.best_by_r2(_scores(v)), ["disease", "model"], ["mae", "rmse", "r2"])


@query("winner", view("forecasts", """
SELECT disease, CASE WHEN seasonal_r2 > blended_r2 THEN 'seasonal' ELSE 'blended' END AS winner, round(seasonal_r2 - blended_r2, 6) AS difference,
  CAST(count(*) OVER (PARTITION BY seasonal_r2 > blended_r2) AS BIGINT) AS wins FROM wide""", _SCORE))
def winner(v):
    # One row per disease, so the win counts are joined on a handful of rows.
    w = evaluate.winner(evaluate.model_comparison(_scores(v), _MODELS), "seasonal", "blended")
    return show(w.join(w.groupBy("winner").agg(F.count("*").alias("wins")), "winner"), ["disease", "winner", "wins"], ["difference"])


@query("overfit_flag", view("forecasts", """
SELECT disease, model, r2 < -0.1 AS poor, round(rmse / sd, 6) AS rmse_to_std FROM sc
JOIN (SELECT disease, stddev_pop(target) AS sd FROM forecasts WHERE split = 'test' GROUP BY disease) USING (disease)""", _SCORE))
def overfit_flag(v):
    std = v.forecasts.filter("split = 'test'").groupBy("disease").agg(F.stddev_pop("target").alias("std"))
    return show(evaluate.overfit_flag(_scores(v).join(std, "disease")), ["disease", "model", "poor"], ["rmse_to_std"])


_CONTRIB = ["T2M_avg", "T2M_max", "RH2M_avg", "RH2M_min", "PRECTOTCORR_avg", "sin_week", "cos_week"]


@query("importance_mean_abs", view("panel", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({c} - (SELECT avg({c}) FROM panel))), 6) AS mean_abs FROM panel" for c in _CONTRIB) + " ORDER BY mean_abs DESC LIMIT 5"))
def importance_mean_abs(v):
    mean = v.panel.agg(F.struct(*[F.avg(c).alias(c) for c in _CONTRIB])).scalar()
    df = v.panel.select(*[(F.col(c) - mean.getField(c)).alias(c) for c in _CONTRIB])
    return show(evaluate.mean_abs_contribution(df, _CONTRIB, 5), ["feature"], ["mean_abs"])
