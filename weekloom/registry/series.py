"""Queries over windows, features, splits, series, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.constants import MODEL_FEATURES, ROLLING_WINDOWS, TARGET_LAGS
from weekloom.functions import dates, numbers
from weekloom.operators import features, joins, series, splits, weekly
from weekloom.operators.tidy import in_range
from weekloom.registry.base import out, query, show
from weekloom.registry.sql import view

KEY = ["disease", "district", "week_start"]
W = "(PARTITION BY disease, district ORDER BY week_start)"


@query("block_week", view("climate_daily", """
SELECT district, d, CAST((d - min(d) OVER (PARTITION BY district)) // 7 AS BIGINT) AS block_week_id FROM climate_daily"""))
def block_week(v):
    return weekly.block_week(v.climate_daily).select("district", "d", "block_week_id")


@query("epi_week", """
SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_end FROM events""")
def epi_week(v):
    return v.table("events").select("event_id", dates.week_start("ts").alias("week_start"), dates.week_end("ts").alias("week_end"))


_CLAG = [f"{c}_lag_{k}" for c in ("PRECTOTCORR_avg", "T2M_avg", "RH2M_avg") for k in range(1, 7)]


@query("climate_lags", view("panel_wide", "SELECT district, week_start, " + ", ".join(
    f"round(lag({c}, {k}) OVER (PARTITION BY district ORDER BY week_start), 6) AS {c}_lag_{k}" for c in ("PRECTOTCORR_avg", "T2M_avg", "RH2M_avg") for k in range(1, 7)) + " FROM panel_wide"))
def climate_lags(v):
    return show(features.climate_lags(v.panel_wide, ["district"]), ["district", "week_start"], _CLAG)


_TLAG = [f"target_lag_{k}" for k in TARGET_LAGS]


@query("target_lags", view("series", f"SELECT {out(KEY)}, " + ", ".join(f"lag(target, {k}) OVER {W} AS target_lag_{k}" for k in TARGET_LAGS) + " FROM series"))
def target_lags(v):
    return features.target_lags(v.series).select(*KEY, *_TLAG)


@query("target_rolling", view("series", f"SELECT {out(KEY)}, " + ", ".join(
    f"round(CAST({f}(target) OVER (PARTITION BY disease, district ORDER BY week_start ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS DOUBLE), 6) AS target_roll_{s}_{n}"
    for n in ROLLING_WINDOWS for f, s in (("avg", "mean"), ("stddev_samp", "std"), ("max", "max"), ("min", "min"))) + " FROM series"))
def target_rolling(v):
    return show(features.target_rolling(v.series), KEY, [f"target_roll_{s}_{n}" for n in ROLLING_WINDOWS for s in ("mean", "std", "max", "min")])


@query("strict_rolling", view("series", f"""
SELECT {out(KEY)}, CASE WHEN count(target) OVER f = 4 THEN round(avg(target) OVER f, 6) END AS strict_mean_4,
  CASE WHEN count(target) OVER f = 4 THEN round(stddev_samp(target) OVER f, 6) END AS strict_std_4
FROM series WINDOW f AS (PARTITION BY disease, district ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""))
def strict_rolling(v):
    return show(features.strict_rolling(v.series), KEY, ["strict_mean_4", "strict_std_4"])


_TREND = ["target_trend_4", "target_trend_8", "target_accel"]


@query("target_trend", view("features", f"SELECT {out(KEY, _TREND)} FROM features"))
def target_trend(v):
    return show(features.target_trend(features.target_rolling(v.series, [4, 8])), KEY, _TREND)


_RATIO = ["excess_over_seasonal", "ratio_to_seasonal"]


@query("seasonal_ratio", view("features", f"SELECT {out(KEY, _RATIO)} FROM features"))
def seasonal_ratio(v):
    return show(features.seasonal_ratio(features.target_rolling(features.train_statistics(v.series), [4])), KEY, _RATIO)


_FEATS = list(MODEL_FEATURES)


@query("build_features", view("features", f"SELECT {out([*KEY, 'split', 'target'], _FEATS)} FROM features"))
def build_features(v):
    return show(v.features, [*KEY, "split", "target"], _FEATS)


_FSW = [f"{c}_lag_{k}" for c in ("T2M_max", "T2M_min", "T2M_avg", "RH2M_avg", "PRECTOTCORR_avg") for k in (1, 2)]


@query("fsw_extra_lags", view("panel_wide", "SELECT district, week_start, " + ", ".join(
    f"round(lag({c.rsplit('_lag_', 1)[0]}, {c[-1]}) OVER (PARTITION BY district ORDER BY week_start), 6) AS {c}" for c in _FSW) + " FROM panel_wide"))
def fsw_extra_lags(v):
    base = features.climate_lags(v.panel_wide, ["district"])
    cols = {c: c for c in ("T2M_max", "T2M_min", "T2M_avg", "RH2M_avg", "PRECTOTCORR_avg")}
    return show(features.with_lags(base, cols, (1, 2), ["district"]), ["district", "week_start"], _FSW)


_FILL = ["leptospirosis", "typhus", "T2M_avg"]


@query("ffill_bfill_zero", view("panel_wide", "SELECT district, week_start, " + ", ".join(f"""
  round(CAST(coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY district ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({c} IGNORE NULLS) OVER (PARTITION BY district ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE), 6) AS {c}""" for c in _FILL) + " FROM panel_wide"))
def ffill_bfill_zero(v):
    return show(features.forward_backward_fill(v.panel_wide, _FILL, ["district"]), ["district", "week_start"], _FILL)


_SEQ_SQL = """
SELECT disease, district, week_start, target, CAST(len(s) AS INTEGER) AS steps, CAST(list_sum(s) AS BIGINT) AS total, array_to_string(s, ',') AS history
FROM (SELECT *, list(target) OVER (PARTITION BY disease, district ORDER BY week_start ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS s FROM series) WHERE len(s) = {n}"""


@query("sequences", view("series", _SEQ_SQL.format(n=8)))
def sequences(v):
    df = features.sequences(v.series, ["target"], 8)
    values = F.transform("steps", lambda s: s.getField("target"))
    return df.select(
        *KEY, "target", F.size("steps").alias("steps"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.concat_ws(",", values.cast("array<string>")).alias("history"))


@query("last_n_rows", view("series", """
SELECT disease, district, week_start, target, CAST(rn AS INTEGER) AS newest FROM (
  SELECT *, row_number() OVER (PARTITION BY disease, district ORDER BY week_start DESC) AS rn FROM series) WHERE rn <= 4"""))
def last_n_rows(v):
    return features.last_rows(v.series, 4).select(*KEY, "target", "newest")


@query("sequence_window", view("climate_weekly", """
SELECT district, week_start, round(T2M_avg, 6) AS T2M_avg, round(RH2M_avg, 6) AS RH2M_avg FROM climate_weekly
WHERE week_start BETWEEN DATE '1999-05-31' - 21 AND DATE '1999-05-31' AND district IN (
  SELECT district FROM climate_weekly WHERE week_start BETWEEN DATE '1999-05-31' - 21 AND DATE '1999-05-31' GROUP BY district HAVING count(DISTINCT week_start) = 4)"""))
def sequence_window(v):
    span = in_range(v.climate_weekly, "week_start", "1999-05-10", "1999-05-31")
    complete = joins.in_every_week(span, 4)
    return show(joins.present_in(span, complete, ["district"]), ["district", "week_start"], ["T2M_avg", "RH2M_avg"])


@query("temporal_split", view("series", """
SELECT disease, district, week_start, CASE WHEN rest < 0 THEN 'train' WHEN rest % 2 = 1 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY disease ORDER BY week_start, district) - 1 - CAST(floor(count(*) OVER (PARTITION BY disease) * 0.8) AS BIGINT) AS rest FROM series)"""))
def temporal_split(v):
    df = splits.temporal_split(v.series.drop("split"), ["disease"], ["week_start", "district"])
    return df.select(*KEY, "split")


@query("random_split")
def random_split(v):
    return splits.random_split(v.series.drop("split"), KEY).select(*KEY, "target", "split")


@query("stratified_split")
def stratified_split(v):
    df = v.series.drop("split").withColumn("is_zero", F.col("target") == 0)
    return splits.stratified_split(df, ["disease", "is_zero"], ["district", "week_start"]).select(*KEY, "target", "split")


@query("tail_split", view("series", """
SELECT disease, district, week_start, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY disease ORDER BY week_start, district) AS rn, count(*) OVER (PARTITION BY disease) AS n FROM series)"""))
def tail_split(v):
    return splits.tail_split(v.series.drop("split"), ["disease"], ["week_start", "district"]).select(*KEY, "split")


@query("split_by_week_range", view("series", """
SELECT disease, district, week_start, 'train' AS split FROM series WHERE week_index <= (SELECT max(week_index) FROM series WHERE split = 'train')
UNION ALL SELECT disease, district, week_start, 'val' FROM series WHERE week_index BETWEEN (SELECT min(week_index) FROM series WHERE split = 'val') AND (SELECT max(week_index) FROM series WHERE split = 'val')
UNION ALL SELECT disease, district, week_start, 'test' FROM series WHERE week_index >= (SELECT min(week_index) FROM series WHERE split = 'test')"""))
def split_by_week_range(v):
    return splits.split_by_week_range(v.series.drop("split"), v.series).select(*KEY, "split")


_TOTALS = {"tot": "SELECT disease, week_start, week_index, sum(target) AS y FROM series GROUP BY ALL"}


def _totals(v):
    return v.series.groupBy("disease", "week_start", "week_index").agg(F.sum("target").alias("y"))


@query("acf", view("series", " UNION ALL ".join(
    f"SELECT disease, {k} AS lag, round(sum(x * l{k}) / sum(x * x), 6) AS acf FROM lx GROUP BY disease" if k else "SELECT disease, 0 AS lag, 1.0::DOUBLE AS acf FROM lx GROUP BY disease"
    for k in range(21)), {**_TOTALS, "cx": "SELECT *, y - avg(y) OVER (PARTITION BY disease) AS x FROM tot",
    "lx": "SELECT *, " + ", ".join(f"lag(x, {k}) OVER (PARTITION BY disease ORDER BY week_start) AS l{k}" for k in range(1, 21)) + " FROM cx"}))
def acf(v):
    return show(series.acf(_totals(v), ["disease"], "week_start", "y"), ["disease", "lag"], ["acf"])


@query("pacf_yw")
def pacf_yw(v):
    return show(series.pacf(series.acf(_totals(v), ["disease"], "week_start", "y"), ["disease"]), ["disease", "lag"], ["pacf"])


@query("unit_root_screen", view("series", """
SELECT disease, district, round(slope, 6) AS slope, CAST(n AS BIGINT) AS n, round(t, 4) AS t_stat, t < -2.86 AS stationary FROM (
  SELECT disease, district, slope, n, slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t FROM (
    SELECT disease, district, regr_slope(y - x, x) AS slope, regr_sxx(y - x, x) AS sxx, regr_syy(y - x, x) AS syy, regr_sxy(y - x, x) AS sxy, regr_count(y - x, x) AS n
    FROM (SELECT disease, district, target AS y, lag(target) OVER """ + W + """ AS x FROM series) GROUP BY ALL))"""))
def unit_root_screen(v):
    df = series.unit_root_screen(v.series, ["disease", "district"], "week_start", "target")
    return df.select("disease", "district", F.round("slope", 6).alias("slope"), "n", F.round("t_stat", 4).alias("t_stat"), "stationary")


_DECOMP = {**_TOTALS, "tr": """SELECT *, (row_number() OVER w - 1) % 26 AS pos, row_number() OVER w AS rn,
  CASE WHEN count(y) OVER f = 27 THEN (sum(y) OVER f - (lag(y, 13) OVER w + lead(y, 13) OVER w) / 2.0) / 26 END AS trend
  FROM tot WINDOW w AS (PARTITION BY disease ORDER BY week_start), f AS (PARTITION BY disease ORDER BY week_start ROWS BETWEEN 13 PRECEDING AND 13 FOLLOWING)""",
  "pat": "SELECT disease, pos, avg(y - trend) AS p FROM tr GROUP BY ALL",
  "cen": "SELECT pat.disease, pos, p - m AS seasonal FROM pat JOIN (SELECT disease, avg(p) AS m FROM pat GROUP BY disease) q ON pat.disease = q.disease"}


@query("seasonal_decompose", view("series", """
SELECT disease, week_start, CAST(y AS BIGINT) AS y, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(y - trend - seasonal, 6) AS residual
FROM tr JOIN cen USING (disease, pos)""", _DECOMP))
def seasonal_decompose(v):
    df = series.seasonal_decompose(_totals(v), ["disease"], "week_start", "y")
    return show(df, ["disease", "week_start", "y"], ["trend", "seasonal", "residual"])


# A learning curve stand-in: per disease, week number k as the round, mean absolute error of two forecasts as the metrics.
_CURVE = {"cv": """SELECT disease, week_number AS round_no, round(avg(abs(target - a)), 9) AS m1, round(avg(abs(target - b)), 9) AS m2 FROM forecasts GROUP BY ALL"""}


def _curve(v):
    err = lambda c: F.round(F.avg(F.abs(F.col("target") - F.col(c))), 9)
    return v.forecasts.groupBy("disease", F.col("week_number").cast("bigint").alias("round_no")).agg(err("a").alias("m1"), err("b").alias("m2"))


@query("curve_normalise", view("forecasts", """
SELECT disease, round_no, round(m1 / first_value(m1) OVER (PARTITION BY disease ORDER BY round_no), 6) AS normalised FROM cv""", _CURVE))
def curve_normalise(v):
    return show(series.curve_normalise(_curve(v), ["disease"], "round_no", "m1"), ["disease", "round_no"], ["normalised"])


@query("curve_smooth_flag", view("forecasts", """
SELECT disease, round(max(m1 - lo), 6) AS rise, max(m1 - lo) <= 0.01 AS smooth FROM cv JOIN (
  SELECT disease, min(m1) AS lo, arg_min(round_no, (m1, round_no)) AS best_at FROM cv GROUP BY disease) USING (disease) WHERE round_no >= best_at GROUP BY disease""", _CURVE))
def curve_smooth_flag(v):
    return show(series.curve_smooth_flag(_curve(v), ["disease"], "round_no", "m1"), ["disease", "smooth"], ["rise"])


@query("curve_best_round", view("forecasts", """
SELECT disease, arg_min(round_no, (m1, round_no)) AS best, least(greatest(arg_min(round_no, (m1, round_no)), 10), 40) AS best_capped, round(min(m1), 6) AS lowest FROM cv GROUP BY disease""", _CURVE))
def curve_best_round(v):
    return show(series.curve_best_round(_curve(v), ["disease"], "round_no", "m1", 10, 40), ["disease", "best", "best_capped"], ["lowest"])


@query("curve_truncate", view("forecasts", """
SELECT disease, round_no, round((m1 + m2) / 2, 6) AS mean_curve FROM cv JOIN (
  SELECT disease, arg_min(round_no, ((m1 + m2) / 2, round_no)) AS best_at FROM cv GROUP BY disease) USING (disease) WHERE round_no <= best_at""", _CURVE))
def curve_truncate(v):
    return show(series.curve_truncate(_curve(v), ["disease"], "round_no", ["m1", "m2"]), ["disease", "round_no"], ["mean_curve"])


@query("ema", view("series", """
SELECT disease, week_start, round(ema, 6) AS ema FROM r""", {**_TOTALS,
    "o": "SELECT *, row_number() OVER (PARTITION BY disease ORDER BY week_start) AS rn FROM tot",
    "r": """SELECT a.disease, a.week_start, sum(CASE WHEN b.rn = 1 THEN b.y * pow(0.88, a.rn - 1) ELSE 0.12 * b.y * pow(0.88, a.rn - b.rn) END) AS ema
FROM o a JOIN o b ON a.disease = b.disease AND b.rn <= a.rn GROUP BY ALL"""}))
def ema(v):
    return show(series.ema(_totals(v), ["disease"], "week_start", "y"), ["disease", "week_start"], ["ema"])


@query("sort_panel", view("cases_weekly", "SELECT district, week_start, disease, target FROM cases_weekly ORDER BY district, week_start, disease"))
def sort_panel(v):
    return v.cases_weekly.orderBy("district", "week_start", "disease").select("district", "week_start", "disease", "target")


@query("topk_rain", view("panel_wide", """
SELECT district, week_start, round(PRECTOTCORR_avg, 6) AS PRECTOTCORR_avg, leptospirosis, typhus, hepatitis_a, chickenpox FROM panel_wide
WHERE PRECTOTCORR_avg IS NOT NULL ORDER BY round(PRECTOTCORR_avg, 9) DESC, district, week_start LIMIT 10"""))
def topk_rain(v):
    top = v.panel_wide.orderBy(F.desc(F.round("PRECTOTCORR_avg", 9)), "district", "week_start").limit(10)
    return show(top, ["district", "week_start", "leptospirosis", "typhus", "hepatitis_a", "chickenpox"], ["PRECTOTCORR_avg"])


@query("topk_abs", view("forecasts", """
SELECT disease, district, week_start, round(a - b, 6) AS gap FROM forecasts ORDER BY round(abs(a - b), 9) DESC, disease, district, week_start LIMIT 20"""))
def topk_abs(v):
    gap = v.forecasts.withColumn("gap", F.col("a") - F.col("b"))
    return show(gap.orderBy(F.desc(F.round(F.abs("gap"), 9)), *KEY).limit(20), KEY, ["gap"])


@query("first_n_distinct", view("series", "SELECT DISTINCT week_start FROM series WHERE target > 2 ORDER BY week_start LIMIT 5"))
def first_n_distinct(v):
    return v.series.filter("target > 2").select("week_start").distinct().orderBy("week_start").limit(5)


@query("sample_rows", view("cases_weekly", """
SELECT district, week_start, disease, target FROM cases_weekly ORDER BY district, week_start, disease LIMIT 100"""))
def sample_rows(v):
    # head(n) is the operator; a total order makes it repeatable and each task keeps n rows only.
    return v.cases_weekly.orderBy("district", "week_start", "disease").limit(100).select("district", "week_start", "disease", "target")


_SEASON = ["month", "week_number"]


@query("seasonal_encoding", view("climate_weekly", """
SELECT district, week_start, CAST(month(week_start) AS BIGINT) AS month, CAST(weekofyear(week_start) AS BIGINT) AS week_number,
  month(week_start) IN (10, 11) AS monsoon_IM2, month(week_start) IN (12, 1, 2) AS monsoon_NE, month(week_start) BETWEEN 5 AND 9 AS monsoon_SW,
  round(sin(2 * pi() * weekofyear(week_start) / 52), 6) AS sin_week, round(cos(2 * pi() * weekofyear(week_start) / 52), 6) AS cos_week FROM climate_weekly"""))
def seasonal_encoding(v):
    df = weekly.seasonal_encoding(v.climate_weekly)
    return show(df, ["district", "week_start", "monsoon_IM2", "monsoon_NE", "monsoon_SW"], ["sin_week", "cos_week"], _SEASON)


_INTER = ["heat_humidity", "rain_humidity", "rain_temp", "temp_range", "rain_hum_lag1", "rain_hum_lag2", "cum_rain_4w", "cum_rain_8w"]


@query("climate_interactions", view("features", f"SELECT {out(KEY, _INTER)} FROM features"))
def climate_interactions(v):
    return show(features.climate_interactions(features.climate_lags(v.panel)), KEY, _INTER)


@query("district_code", view("cases_weekly", """
SELECT district, week_start, disease, CAST(code AS BIGINT) AS district_enc FROM cases_weekly
JOIN (SELECT district, row_number() OVER (ORDER BY district) - 1 AS code FROM (SELECT DISTINCT district FROM cases_weekly)) USING (district)"""))
def district_code(v):
    return features.district_code(v.cases_weekly).select("district", "week_start", "disease", F.col("district_enc").cast("bigint").alias("district_enc"))


@query("capped_range", view("forecasts", """
SELECT disease, district, week_start, round(CASE WHEN a - a * 0.4 > 0 THEN a - 0.5 * (a - a * 0.4) ELSE a * 0.4 END, 6) AS low,
  round(CASE WHEN (a + b) - a > 0 THEN a + 0.5 * ((a + b) - a) ELSE a + b END, 6) AS high FROM forecasts"""))
def capped_range(v):
    lo, mid, hi = F.col("a") * 0.4, F.col("a"), F.col("a") + F.col("b")
    return show(v.forecasts.withColumns({"low": numbers.capped_low(lo, mid), "high": numbers.capped_high(mid, hi)}), KEY, ["low", "high"])


@query("forecast_gate", view("calendar", """
SELECT district, week_start, greatest(week_start - DATE '2001-06-01', 0) <= 7 AND week_start > DATE '2001-05-21' AS api_allowed,
  greatest(week_start - DATE '2001-06-01', 0) <= 14 AND week_start > DATE '2001-05-21' AS view_allowed FROM calendar"""))
def forecast_gate(v):
    today, last = F.lit("2001-06-01").cast("date"), F.lit("2001-05-21").cast("date")
    return v.calendar.select(
        "district", "week_start", dates.forecast_gate("week_start", today, last, 7).alias("api_allowed"),
        dates.forecast_gate("week_start", today, last, 14).alias("view_allowed"))
