"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.constants import DISEASES
from weekloom.functions.numbers import clip
from weekloom.operators import features, joins, weekly
from weekloom.operators.blend import weight_errors
from weekloom.registry.base import out, query, show
from weekloom.registry.sql import view

KEY = ["disease", "district", "week_start"]


def _dated(df):
    return df.withColumns({"start_date": F.col("week_start"), "end_date": F.date_add("week_start", 6)}).drop("week_start")


_JOINED = f"""
SELECT c.district, c.week_start AS start_date, CAST(c.week_start + 6 AS DATE) AS end_date, round(T2M_avg, 6) AS T2M_avg,
  round(PRECTOTCORR_avg, 6) AS PRECTOTCORR_avg, {', '.join(DISEASES)}
FROM climate_weekly c LEFT JOIN cases_wide USING (district, week_start)"""


@query("join_weather_cases", view(("climate_weekly", "cases_wide"), _JOINED))
def join_weather_cases(v):
    cases = weekly.count_weekly_wide(v.cases_daily)
    df = joins.attach_cases(_dated(v.climate_weekly), _dated(cases))
    return show(df, ["district", "start_date", "end_date", *DISEASES], ["T2M_avg", "PRECTOTCORR_avg"])


@query("join_match_rate", view(("climate_weekly", "cases_wide"), " UNION ALL ".join(f"""
SELECT '{d}' AS disease, CAST(min({d}) AS BIGINT) AS lowest, CAST(max({d}) AS BIGINT) AS highest, round(avg({d}), 6) AS mean,
  CAST(count(*) FILTER (WHERE {d} > 0) AS BIGINT) AS non_zero, round(avg(CASE WHEN {d} > 0 THEN 1.0 ELSE 0.0 END), 6) AS matched_share
FROM climate_weekly LEFT JOIN cases_wide USING (district, week_start)""" for d in DISEASES)))
def join_match_rate(v):
    df = joins.attach_cases(_dated(v.climate_weekly), _dated(weekly.count_weekly_wide(v.cases_daily)))
    cells = F.array(*[
        F.struct(
            F.lit(d).alias("disease"), F.min(d).alias("lowest"), F.max(d).alias("highest"), F.avg(d).alias("mean"),
            F.count_if(F.col(d) > 0).alias("non_zero"), (F.count_if(F.col(d) > 0) / F.count("*")).alias("matched_share"))
        for d in DISEASES])
    df = df.agg(cells.alias("cells")).select(F.inline("cells"))
    return show(df, ["disease", "lowest", "highest", "non_zero"], ["mean", "matched_share"])


_STATS = ["district_week_mean", "late_dist_mean", "dist_mean"]


@query("join_train_stats", view("series", f"""
SELECT s.disease, s.district, s.week_start, round(coalesce(m.m, dm.m), 6) AS district_week_mean,
  round(coalesce(lm.m, dm.m), 6) AS late_dist_mean, round(dm.m, 6) AS dist_mean
FROM series s
LEFT JOIN (SELECT disease, district, week_number, avg(target) AS m FROM series WHERE split = 'train' GROUP BY ALL) m
  ON s.disease = m.disease AND s.district = m.district AND s.week_number = m.week_number
LEFT JOIN (SELECT disease, district, avg(target) AS m FROM series WHERE split = 'train' GROUP BY ALL) dm
  ON s.disease = dm.disease AND s.district = dm.district
LEFT JOIN (SELECT disease, district, avg(target) AS m FROM series WHERE split = 'train'
   AND week_index >= (SELECT max(week_index) - 52 FROM series WHERE split = 'train') GROUP BY ALL) lm
  ON s.disease = lm.disease AND s.district = lm.district"""))
def join_train_stats(v):
    return show(features.train_statistics(v.series), KEY, _STATS)


_FACTOR = "SELECT disease, district, greatest(0.3, least(4.0, sum(target) / nullif(sum(a), 0))) AS factor FROM forecasts WHERE split = 'val' GROUP BY ALL HAVING sum(target) > 3"


@query("lookup_default", view("forecasts", f"""
SELECT f.disease, f.district, week_start, round(coalesce(factor, 1.0), 6) AS factor FROM forecasts f
LEFT JOIN ({_FACTOR}) k ON f.disease = k.disease AND f.district = k.district"""))
def lookup_default(v):
    factor = (
        v.forecasts.filter("split = 'val'").groupBy("disease", "district")
        .agg(F.sum("target").alias("y"), F.sum("a").alias("p")).filter("y > 3")
        .select("disease", "district", clip(F.col("y") / F.nullif(F.col("p"), F.lit(0.0)), 0.3, 4.0).alias("factor"))
    )
    return show(joins.lookup(v.forecasts, factor, ["disease", "district"], {"factor": 1.0}), KEY, ["factor"])


@query("lookup_hierarchical", view("series", """
SELECT s.disease, s.district, s.week_start, round(coalesce(f.m, c.m, r.m), 6) AS seasonal_mean
FROM series s LEFT JOIN (SELECT disease, avg(m) AS m FROM (SELECT disease, avg(target) AS m FROM series
   WHERE split = 'train' AND target > 0 GROUP BY disease, week_number) GROUP BY disease) r ON s.disease = r.disease
LEFT JOIN (SELECT disease, district, week_number, avg(target) AS m FROM series WHERE split = 'train' AND target > 0 GROUP BY ALL) f
  ON s.disease = f.disease AND s.district = f.district AND s.week_number = f.week_number
LEFT JOIN (SELECT disease, week_number, avg(target) AS m FROM series WHERE split = 'train' AND target > 0 GROUP BY ALL) c
  ON s.disease = c.disease AND s.week_number = c.week_number"""))
def lookup_hierarchical(v):
    train = v.series.filter("split = 'train' AND target > 0")
    df = joins.hierarchical_mean(v.series, train, ["disease", "district", "week_number"], ["disease", "week_number"])
    return show(df, KEY, ["seasonal_mean"])


_LAGGED = [f"{c}_lag_{k}" for c in ("T2M_avg", "RH2M_avg") for k in range(1, 7)]


@query("join_lag_weeks", view("climate_weekly", "SELECT " + out(["c.district", "c.week_start"], []) + ", " + ", ".join(
    f"round(w{k}.{c}, 6) AS {c}_lag_{k}" for c in ("T2M_avg", "RH2M_avg") for k in range(1, 7)) + " FROM climate_weekly c " + " ".join(
    f"JOIN climate_weekly w{k} ON w{k}.district = c.district AND w{k}.week_start = c.week_start - {7 * k}" for k in range(1, 7))))
def join_lag_weeks(v):
    df = joins.lag_weeks(v.climate_weekly, ["T2M_avg", "RH2M_avg"], 6, ["district"])
    return show(df, ["district", "week_start"], _LAGGED)


@query("align_districts", view("climate_weekly", """
SELECT district, week_start, round(T2M_avg, 6) AS T2M_avg FROM climate_weekly WHERE district IN
  (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""))
def align_districts(v):
    places = v.table("supplier").join(v.table("nation"), F.expr("s_nationkey = n_nationkey")).select(F.col("n_name").alias("district"))
    return show(joins.present_in(v.climate_weekly, places, ["district"]), ["district", "week_start"], ["T2M_avg"])


@query("districts_in_all_weeks", view("cases_weekly", """
SELECT disease, district, CAST(count(DISTINCT week_start) AS BIGINT) AS weeks FROM cases_weekly
WHERE week_start BETWEEN DATE '1998-03-02' AND DATE '1998-03-09' GROUP BY ALL HAVING count(DISTINCT week_start) = 2"""))
def districts_in_all_weeks(v):
    from weekloom.operators.tidy import in_range

    span = in_range(v.cases_weekly, "week_start", "1998-03-02", "1998-03-09")
    each = span.withColumn("area", F.struct("disease", "district"))
    return joins.in_every_week(each, 2, "area").select("area.*", "weeks")


def _three(v):
    f = v.forecasts.filter("split = 'test'")
    score = lambda c, m: f.groupBy("disease").agg(
        F.avg(F.abs(F.col("target") - c)).alias(f"{m}_mae"), F.sqrt(F.avg((F.col("target") - c) ** 2)).alias(f"{m}_rmse"))
    a, b = F.col("a"), F.col("b")
    return score(a, "recent"), score(b, "seasonal"), score(a * 0.5 + b * 0.5, "blend")


def _score_sql(c, m, where=""):
    return f"SELECT disease, avg(abs(target - ({c}))) AS {m}_mae, sqrt(avg((target - ({c})) ** 2)) AS {m}_rmse FROM forecasts WHERE split = 'test' {where} GROUP BY disease"


_THREE = ["recent_mae", "recent_rmse", "seasonal_mae", "seasonal_rmse", "blend_mae", "blend_rmse"]


@query("join_metrics_3way", view("forecasts", f"""
SELECT {out(['disease'], _THREE)} FROM ({_score_sql('a', 'recent')}) JOIN ({_score_sql('b', 'seasonal')}) USING (disease)
JOIN ({_score_sql('a * 0.5 + b * 0.5', 'blend')}) USING (disease)"""))
def join_metrics_3way(v):
    x, y, z = _three(v)
    return show(x.join(y, "disease").join(z, "disease"), ["disease"], _THREE)


@query("join_metrics_fallback", view("forecasts", f"""
SELECT disease, round(recent_mae, 6) AS recent_mae, round(coalesce(n.seasonal_mae, o.old_mae), 6) AS seasonal_mae,
  round(coalesce(n.seasonal_rmse, o.old_rmse), 6) AS seasonal_rmse
FROM ({_score_sql('a', 'recent')}) LEFT JOIN ({_score_sql('b', 'seasonal', "AND disease IN ('typhus', 'chickenpox')")}) n USING (disease)
LEFT JOIN ({_score_sql('b + 1', 'old', "AND disease <> 'leptospirosis'")}) o USING (disease)"""))
def join_metrics_fallback(v):
    x, y, _ = _three(v)
    new = y.filter(F.col("disease").isin("typhus", "chickenpox"))
    f = v.forecasts.filter("split = 'test' AND disease <> 'leptospirosis'")
    old = f.groupBy("disease").agg(
        F.avg(F.abs(F.expr("target - (b + 1)"))).alias("old_mae"), F.sqrt(F.avg(F.expr("target - (b + 1)") ** 2)).alias("old_rmse"))
    df = x.join(new, "disease", "left").join(old, "disease", "left").withColumns(
        {"seasonal_mae": F.coalesce("seasonal_mae", "old_mae"), "seasonal_rmse": F.coalesce("seasonal_rmse", "old_rmse")})
    return show(df, ["disease"], ["recent_mae", "seasonal_mae", "seasonal_rmse"])


@query("cross_weights", view("forecasts", """
SELECT disease, CAST(k AS INTEGER) AS step, round(avg(abs(target - greatest(a * (k / 50.0) + b * (1 - k / 50.0), 0))), 6) AS mae
FROM forecasts, (SELECT unnest(range(51)) AS k) WHERE split = 'val' GROUP BY disease, k"""))
def cross_weights(v):
    return show(weight_errors(v.forecasts.filter("split = 'val'"), ["disease"], 50), ["disease", "step"], ["mae"])


@query("anti_missing_weeks", view(("calendar", "cases_weekly"), """
SELECT district, week_start FROM calendar WHERE (district, week_start) NOT IN (SELECT (district, week_start) FROM cases_weekly WHERE disease = 'typhus')"""))
def anti_missing_weeks(v):
    return joins.missing_keys(v.calendar, v.cases_weekly.filter("disease = 'typhus'"), ["district", "week_start"])


_SMALL = ["disease", "district", "week_start", "split", "target"]


@query("union_splits", view("series", "SELECT disease, district, week_start, split, target FROM series"))
def union_splits(v):
    parts = [v.series.filter(F.col("split") == s).select(*_SMALL) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("union_padded", view(("series", "climate_weekly"), """
SELECT district, week_start, target, CAST(0 AS DOUBLE) AS T2M_avg FROM series
UNION ALL SELECT district, CAST(week_start + 3710 AS DATE), 0, round(T2M_avg, 6) FROM climate_weekly"""))
def union_padded(v):
    past = v.series.select("district", "week_start", "target")
    new = v.climate_weekly.select(
        "district", F.date_add("week_start", 3710).alias("week_start"), F.round("T2M_avg", 6).alias("T2M_avg"))
    return past.unionByName(new, allowMissingColumns=True).fillna(0)


@query("distinct_rows", view("cases_daily", "SELECT DISTINCT district, d, disease FROM cases_daily"))
def distinct_rows(v):
    return v.cases_daily.dropDuplicates()


@query("dedup_keep_last", view("series", """
SELECT district, week_start, arg_max(disease, disease) AS disease, arg_max(target, disease) AS target FROM series GROUP BY ALL"""))
def dedup_keep_last(v):
    return joins.keep_last(v.series.select("district", "week_start", "disease", "target"), ["district", "week_start"], "disease")


@query("intersect_keys", view("series", """
SELECT district, week_number FROM series WHERE split = 'train' INTERSECT SELECT district, week_number FROM series WHERE split = 'test'"""))
def intersect_keys(v):
    part = lambda s: v.series.filter(F.col("split") == s).select("district", F.col("week_number").cast("bigint").alias("week_number"))
    return part("train").intersect(part("test"))
