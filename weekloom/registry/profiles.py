"""Queries over weekly aggregates and descriptive profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.constants import DISEASES, WEEKLY_CLIMATE
from weekloom.functions.dates import week_start
from weekloom.operators import profile, weekly
from weekloom.operators.tidy import monsoon_label
from weekloom.registry.base import out, query, show
from weekloom.registry.sql import climate_agg, view

KEY = ["disease", "district", "week_start"]
W15 = list(WEEKLY_CLIMATE)
SHORT = ["T2M_avg", "RH2M_avg", "PRECTOTCORR_avg", *DISEASES]


@query("weekly_climate_agg", view("climate_daily", f"""
SELECT district, CAST((d - first_day) // 7 AS BIGINT) AS block_week_id, min(d) AS start_date, max(d) AS end_date, {', '.join(
    f'round({f}({c}), 6) AS {c}_{n}' for c in ('T2M', 'T2M_MAX', 'T2M_MIN', 'RH2M', 'PRECTOTCORR') for f, n in (('max', 'max'), ('min', 'min'), ('avg', 'avg')))}
FROM climate_daily JOIN (SELECT district, min(d) AS first_day FROM climate_daily GROUP BY district) USING (district) GROUP BY 1, 2"""))
def weekly_climate_agg(v):
    return show(weekly.block_weekly_climate(v.climate_daily), ["district", "block_week_id", "start_date", "end_date"], W15)


@query("weekly_from_readings", view("readings", f"""
SELECT {out(['district', 'week_start'], W15)} FROM (SELECT district, CAST(date_trunc('week', ts) AS DATE) AS week_start, {climate_agg()}
FROM readings WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY 1, 2)"""))
def weekly_from_readings(v):
    day = lambda s: F.lit(s).cast("date")
    df = weekly.readings_in_week(v.readings, day("2024-01-01"), day("2024-12-31"))
    return show(df, ["district", "week_start"], W15)


_MISS = ["district", "week_start", "week_index", *DISEASES, *W15]


@query("missing_profile", view("panel_wide", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct FROM panel_wide""" for c in _MISS)))
def missing_profile(v):
    return show(profile.missing_profile(v.panel_wide), ["column", "nulls"], ["pct"])


_STATS7 = ["mean", "std", "lowest", "highest"]


@query("describe_profile", view("panel_wide", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS n, round(CAST(avg({c}) AS DOUBLE), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS lowest,
  round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS q1, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS median,
  round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS q3, round(CAST(max({c}) AS DOUBLE), 6) AS highest FROM panel_wide""" for c in [*W15, *DISEASES])))
def describe_profile(v):
    from weekloom.runtime import stored

    df = stored(v.panel_wide, "wide")
    return show(profile.describe_profile(df, [*W15, *DISEASES]), ["variable", "n"], ["mean", "std", "lowest", "q1", "median", "q3", "highest"])


@query("dataset_overview", view("panel", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT district) AS BIGINT) AS districts, min(week_start) AS first_week, max(week_start) AS last_week,
  CAST(count(DISTINCT week_start) AS BIGINT) AS weeks, CAST(max(week_start) - min(week_start) AS BIGINT) AS days FROM panel"""))
def dataset_overview(v):
    return show(profile.dataset_overview(v.panel), ["rows", "districts", "first_week", "last_week", "weeks"], (), ["days"])


_BASIC = "CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS {t}) AS lowest, CAST(max({c}) AS {t}) AS highest, CAST(sum({c}) AS {t}) AS total"


@query("stats_by_district", view("series", f"SELECT disease, district, {_BASIC.format(c='target', t='BIGINT')} FROM series GROUP BY ALL"))
def stats_by_district(v):
    df = profile.stats_by(v.series, ["disease", "district"], "target").orderBy("disease", F.desc("total"), "district")
    return show(df, ["disease", "district"], ["mean", "std"], ["n", "lowest", "highest", "total"])


_SEASON = "CASE WHEN monsoon_IM2 THEN 'IM2' WHEN monsoon_SW THEN 'SW' WHEN monsoon_NE THEN 'NE' ELSE 'None' END"


@query("stats_by_monsoon", view("panel", " UNION ALL ".join(f"""
SELECT {_SEASON} AS monsoon_season, '{c}' AS variable, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM panel GROUP BY 1"""
    for c in ("target", "T2M_avg", "RH2M_avg", "PRECTOTCORR_avg"))))
def stats_by_monsoon(v):
    long = profile.melt(monsoon_label(v.panel), ["monsoon_season"], ["target", "T2M_avg", "RH2M_avg", "PRECTOTCORR_avg"])
    return show(profile.stats_by(long, ["monsoon_season", "variable"], "value"), ["monsoon_season", "variable", "n"], ["mean", "std"])


@query("disease_summary", view("series", """
SELECT disease, CAST(sum(target) AS BIGINT) AS total, round(avg(target), 6) AS mean, CAST(max(target) AS BIGINT) AS highest,
  CAST(count(DISTINCT CASE WHEN target > 0 THEN district END) AS BIGINT) AS districts FROM series GROUP BY disease"""))
def disease_summary(v):
    return show(profile.disease_summary(v.series), ["disease", "districts"], ["mean"], ["total", "highest"])


@query("burden_rollup", view("cases_weekly", """
SELECT disease, district, CAST(sum(target) AS BIGINT) AS cases FROM cases_weekly GROUP BY ROLLUP (disease, district)"""))
def burden_rollup(v):
    return v.cases_weekly.rollup("disease", "district").agg(F.sum("target").alias("cases"))


@query("weekly_totals", view("cases_weekly", "SELECT disease, week_start, CAST(sum(target) AS BIGINT) AS cases FROM cases_weekly GROUP BY ALL"))
def weekly_totals(v):
    # Straight from the daily rows: one shuffle instead of one per level.
    return v.cases_daily.groupBy("disease", week_start("d").alias("week_start")).agg(F.count("*").alias("cases"))


@query("week_number_profile", view("series", """
SELECT disease, week_number, round(avg(target), 6) AS mean, round(stddev_samp(target), 6) AS std FROM series GROUP BY ALL"""))
def week_number_profile(v):
    df = v.series.groupBy("disease", "week_number").agg(F.avg("target").alias("mean"), F.stddev_samp("target").alias("std"))
    return show(df, ["disease"], ["mean", "std"], ["week_number"])


@query("value_counts", view("series", "SELECT disease, target, CAST(count(*) AS BIGINT) AS n FROM series GROUP BY ALL"))
def value_counts(v):
    return v.series.groupBy("disease", "target").agg(F.count("*").alias("n")).orderBy("disease", F.desc("n"), "target")


@query("zero_share", view("series", """
SELECT disease, split, round(100 * avg(CASE WHEN target = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_pct FROM series GROUP BY ALL"""))
def zero_share(v):
    df = v.series.groupBy("disease", "split").agg((F.avg((F.col("target") == 0).cast("double")) * 100).alias("zero_pct"))
    return show(df, ["disease", "split"], ["zero_pct"])


@query("outlier_iqr", view("panel_wide", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high,
  CAST(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers,
  round(100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 6) AS pct
FROM panel_wide, (SELECT CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM panel_wide) GROUP BY q1, q3""" for c in SHORT)))
def outlier_iqr(v):
    from weekloom.runtime import stored

    return show(profile.outlier_iqr(stored(v.panel_wide, "wide"), SHORT), ["variable", "outliers"], ["q1", "q3", "low", "high", "pct"])


_SHAPE = """(SELECT disease, count(target) AS n, avg(target) AS m FROM series GROUP BY disease) s USING (disease)"""
_MOMENTS = f"""(SELECT disease, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM (
  SELECT disease, any_value(n) AS n, avg(pow(target - m, 2)) AS m2, avg(pow(target - m, 3)) AS m3, avg(pow(target - m, 4)) AS m4
  FROM series JOIN {_SHAPE} GROUP BY disease))"""


@query("skew_kurtosis", view("series", f"SELECT disease, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM {_MOMENTS}"))
def skew_kurtosis(v):
    return show(profile.shape_stats(v.series, ["disease"], "target"), ["disease"], ["skew", "kurt"])


@query("normality_jb", view("series", f"""
SELECT disease, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS normal
FROM (SELECT disease, n / 6.0 * (skew * skew + kurt * kurt / 4) AS jb FROM {_MOMENTS})"""))
def normality_jb(v):
    df = profile.normality_jb(v.series, ["disease"], "target")
    return df.select("disease", F.round("jb", 4).alias("jb"), F.round("p_value", 6).alias("p_value"), "normal")


_CORR = ["T2M_avg", "T2M_max", "T2M_min", "RH2M_avg", "RH2M_max", "RH2M_min", "PRECTOTCORR_avg", "PRECTOTCORR_max", "T2M_MAX_avg", "T2M_MIN_avg",
         "month", "week_number", "sin_week", "cos_week", "week_index", "target", "target_lag_1"]
_LAG1 = {"lagged": "SELECT *, lag(target) OVER (PARTITION BY disease, district ORDER BY week_start) AS target_lag_1 FROM panel"}


@query("corr_matrix", view("panel", "UNPIVOT (SELECT " + ", ".join(
    f"round(corr({a}, {b}), 6) AS {a}__{b}" for a in _CORR for b in _CORR) + " FROM lagged) ON COLUMNS(*) INTO NAME pair VALUE corr", _LAG1).replace(
    "UNPIVOT (", "SELECT split_part(pair, '__', 1) AS \"left\", split_part(pair, '__', 2) AS \"right\", corr FROM (UNPIVOT (") + ")")
def corr_matrix(v):
    from weekloom.operators.features import target_lags

    return show(profile.corr_matrix(target_lags(v.panel, [1]), _CORR), ["left", "right"], ["corr"])


_LAGC = [f"{c}_lag_{k}" for c in ("PRECTOTCORR_avg", "T2M_avg", "RH2M_avg") for k in range(1, 7)]
_WIDE_LAG = {"wl": "SELECT *, " + ", ".join(
    f"lag({c}, {k}) OVER (PARTITION BY district ORDER BY week_start) AS {c}_lag_{k}" for c in ("PRECTOTCORR_avg", "T2M_avg", "RH2M_avg") for k in range(1, 7)) + " FROM panel_wide"}
_LAGCORR = " UNION ALL ".join(
    f"SELECT '{c.rsplit('_lag_', 1)[0]}' AS variable, {c.rsplit('_lag_', 1)[1]} AS lag, '{d}' AS disease, corr({c}, coalesce({d}, 0)) AS corr FROM wl"
    for c in _LAGC for d in DISEASES)


def _lag_corr(v):
    from weekloom.operators.features import climate_lags

    return profile.lag_corr(climate_lags(v.panel_wide.fillna(0, list(DISEASES)), ["district"]), _LAGC, DISEASES)


@query("lag_corr", view("panel_wide", f"SELECT variable, lag, disease, round(corr, 6) AS corr FROM ({_LAGCORR})", _WIDE_LAG))
def lag_corr(v):
    return show(_lag_corr(v), ["variable", "lag", "disease"], ["corr"])


@query("best_lag", view("panel_wide", f"""
SELECT disease, variable, arg_max(lag, round(abs(corr), 9)) AS lag, round(arg_max(corr, round(abs(corr), 9)), 6) AS corr FROM ({_LAGCORR}) GROUP BY ALL""", _WIDE_LAG))
def best_lag(v):
    return show(profile.best_lag(_lag_corr(v)), ["disease", "variable", "lag"], ["corr"])


@query("extreme_rain", view("panel", """
SELECT disease, CAST(count(*) FILTER (WHERE wet) AS BIGINT) AS extreme_weeks, round(avg(target) FILTER (WHERE NOT wet), 6) AS normal_mean,
  round(avg(target) FILTER (WHERE wet), 6) AS extreme_mean,
  round((avg(target) FILTER (WHERE wet) - avg(target) FILTER (WHERE NOT wet)) / avg(target) FILTER (WHERE NOT wet) * 100, 4) AS change_pct
FROM (SELECT *, coalesce(PRECTOTCORR_avg > (SELECT quantile_cont(PRECTOTCORR_avg, 0.95) FROM panel), false) AS wet FROM panel) GROUP BY disease"""))
def extreme_rain(v):
    df = profile.extreme_rain(v.kept_panel, "PRECTOTCORR_avg")
    return df.select("disease", "extreme_weeks", F.round("normal_mean", 6).alias("normal_mean"), F.round("extreme_mean", 6).alias("extreme_mean"),
                     F.round("change_pct", 4).alias("change_pct"))


_Z = """(SELECT s.*, (target - m) / sd AS z FROM series s JOIN (SELECT disease, avg(target) AS m, stddev_pop(target) AS sd FROM series GROUP BY disease) USING (disease))"""


@query("zscore_anomaly", view("series", f"""
SELECT disease, CAST(count(*) AS BIGINT) AS anomalies, CAST(max(target) AS BIGINT) AS peak,
  arg_max(district, (target, ord)) AS peak_district, arg_max(week_start, (target, ord)) AS peak_week
FROM (SELECT *, -row_number() OVER (ORDER BY district, week_start) AS ord FROM {_Z}) WHERE abs(z) > 2.5 GROUP BY disease"""))
def zscore_anomaly(v):
    df = profile.anomaly_summary(profile.zscore_anomaly(v.kept_series))
    return show(df, ["disease", "peak_district", "peak_week"], (), ["anomalies", "peak"])


_MULTI = ["T2M_avg", "RH2M_avg", "PRECTOTCORR_avg", *DISEASES]


@query("multivariate_anomaly")
def multivariate_anomaly(v):
    from weekloom.runtime import stored

    df = stored(v.panel_wide.fillna(0, list(DISEASES)), "wide")
    return show(profile.multivariate_anomaly(df, _MULTI), ["district", "week_start"], ["distance"])


def _hist_sql(c, bins):
    return f"""SELECT '{c}' AS variable, CAST(least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n
FROM rw, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM rw) WHERE {c} IS NOT NULL GROUP BY 1, 2"""


@query("histogram", view("panel_wide", " UNION ALL ".join(_hist_sql(c, 30) for c in SHORT),
    {"rw": "SELECT " + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in SHORT) + " FROM panel_wide"}))
def histogram(v):
    # Rounded so that means summed in another order fall into the same bin on both engines.
    return profile.equal_width_bins(v.panel_wide.select(*[F.round(F.col(c).cast("double"), 9).alias(c) for c in SHORT]), SHORT, 30)


@query("box_numbers", view("panel", f"""
SELECT disease, {_SEASON} AS monsoon_season, CAST(min(target) AS DOUBLE) AS lowest, CAST(quantile_cont(target, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(target, 0.5) AS DOUBLE) AS median,
  CAST(quantile_cont(target, 0.75) AS DOUBLE) AS q3, CAST(max(target) AS DOUBLE) AS highest FROM panel GROUP BY 1, 2"""))
def box_numbers(v):
    return profile.five_numbers(monsoon_label(v.panel), ["disease", "monsoon_season"], "target")
