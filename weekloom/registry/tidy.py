"""Queries over projections, filters, predicates and type repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.constants import DISEASES, EXPECTED_RANGES, SEASON_COLUMNS, WEEKLY_CLIMATE
from weekloom.functions import numbers, text
from weekloom.operators import joins, tidy
from weekloom.operators.features import climate_lags, series_window
from weekloom.operators.weekly import block_weekly_climate
from weekloom.registry.base import out, query, show
from weekloom.registry.sql import view

KEY = ["disease", "district", "week_start"]


@query("parse_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dashed, CAST(o_orderdate AS DATE) AS compact FROM orders""")
def parse_dates(v):
    as_text = v.table("orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format("o_orderdate", "yyyyMMdd").alias("b"))
    return as_text.select("o_orderkey", F.to_date("a").alias("dashed"), F.to_date("b", "yyyyMMdd").alias("compact"))


@query("bool_repair", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS flag FROM orders""")
def bool_repair(v):
    s = F.col("o_orderstatus")
    raw = F.when(s == "F", " True ").when(s == "O", "False ").otherwise("unknown")
    return v.table("orders").select("o_orderkey", text.bool_from_text(raw).alias("flag"))


@query("bool_to_num", view("panel", """
SELECT disease, district, week_start, CAST(monsoon_IM2 AS INTEGER) AS monsoon_IM2, CAST(monsoon_NE AS INTEGER) AS monsoon_NE,
  CAST(monsoon_SW AS INTEGER) AS monsoon_SW FROM panel"""))
def bool_to_num(v):
    return v.panel.select(*KEY, *[F.col(c).cast("int").alias(c) for c in ("monsoon_IM2", "monsoon_NE", "monsoon_SW")])


@query("count_to_int", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity * 1.5) AS BIGINT) AS n FROM lineitem")
def count_to_int(v):
    # Casting a double to BIGINT truncates; quantities are positive.
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 1.5).cast("bigint").alias("n"))


@query("district_clean", """
SELECT o_orderkey, CASE WHEN n_nationkey = 5 THEN 'Nuwara Eliya' ELSE n_name END AS district
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 9""")
def district_clean(v):
    k = F.col("n_nationkey")
    raw = F.when(k == 5, "NuwaraEliya ").when(k == 9, "Kalmune").otherwise(F.concat(F.lit("  "), "n_name"))
    return tidy.clean_district(v.order_district.select("o_orderkey", raw.alias("district")))


@query("disease_slug", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'leptospirosis' WHEN '2-HIGH' THEN 'typhus' WHEN '3-MEDIUM' THEN 'hepatitis_a'
  WHEN '5-LOW' THEN 'chickenpox' ELSE 'not_specified' END AS slug, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def disease_slug(v):
    p = F.col("o_orderpriority")
    name = (F.when(p == "1-URGENT", "Leptospirosis").when(p == "2-HIGH", "Typhus").when(p == "3-MEDIUM", "Hepatitis A")
            .when(p == "5-LOW", "Chickenpox").otherwise("Not Specified"))
    return v.table("orders").groupBy(text.slug(name).alias("slug")).agg(F.count("*").alias("n"))


@query("drop_null_key", view("panel_cases", "SELECT district, week_start, leptospirosis FROM panel_cases WHERE leptospirosis IS NOT NULL"))
def drop_null_key(v):
    return v.panel_cases.na.drop(subset=["leptospirosis"]).select("district", "week_start", "leptospirosis")


@query("drop_any_null", view("series", """
SELECT * FROM (SELECT disease, district, week_start, target, lag(target, 1) OVER w AS target_lag_1, lag(target, 6) OVER w AS target_lag_6
  FROM series WINDOW w AS (PARTITION BY disease, district ORDER BY week_start)) WHERE target_lag_6 IS NOT NULL"""))
def drop_any_null(v):
    w = series_window()
    lagged = v.series.select(*KEY, "target", *[F.lag("target", k).over(w).alias(f"target_lag_{k}") for k in (1, 6)])
    return lagged.na.drop("any")


@query("filter_districts", view("cases_weekly", """
SELECT district, week_start, disease, target FROM cases_weekly WHERE district IN ('NATION_1', 'NATION_7', 'NATION_24')"""))
def filter_districts(v):
    return tidy.in_list(v.cases_weekly, "district", "NATION_1, NATION_7 ,NATION_24").select("district", "week_start", "disease", "target")


@query("filter_date_range", view("cases_weekly", """
SELECT district, week_start, disease, target FROM cases_weekly WHERE week_start BETWEEN DATE '1997-01-06' AND DATE '1998-12-28'"""))
def filter_date_range(v):
    return tidy.in_range(v.cases_weekly, "week_start", "1997-01-06", "1998-12-28").select("district", "week_start", "disease", "target")


_FEATURE_VIEW = ["T2M_avg", "RH2M_avg", "PRECTOTCORR_avg", "month", "week_number", "week_index"]


@query("select_features", view("panel", f"SELECT {out(KEY, _FEATURE_VIEW)} FROM panel"))
def select_features(v):
    df = v.panel.select(*KEY, "split", "target", *_FEATURE_VIEW)
    return show(df, KEY, tidy.columns_except(df, [*KEY, "split", "target"]))


_HUMID_LAGS = [f"RH2M_avg_lag_{k}" for k in range(1, 7)]


@query("select_by_pattern", view("features", f"SELECT {out(KEY, _HUMID_LAGS)} FROM features"))
def select_by_pattern(v):
    df = climate_lags(v.panel)
    return show(df, KEY, tidy.columns_matching(df, ["RH2M"], lagged=True))


_CATALOG = ["district", "week_start", "week_index", *WEEKLY_CLIMATE, *DISEASES, *SEASON_COLUMNS]


def _category(c):
    if c.startswith(("T2M", "RH2M", "PRECTOTCORR")):
        return "climate"
    if c in SEASON_COLUMNS:
        return "season"
    return "disease" if c in DISEASES else "key" if c == "district" else "time"


@query("column_catalog", view("panel_wide", f"""
SELECT * FROM (SELECT 'x' AS "column", 'x' AS category, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS filled WHERE false) UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', '{_category(c)}', CAST(count(*) - count({s}) AS BIGINT), CAST(count({s}) AS BIGINT) FROM panel_wide"
    for c in _CATALOG for s in ["week_start" if c in SEASON_COLUMNS else c])))
def column_catalog(v):
    from weekloom.operators.weekly import seasonal_encoding

    return tidy.column_catalog(seasonal_encoding(v.panel_wide)).select("column", "category", "nulls", "filled")


@query("fill_zero", view("panel_wide", "SELECT district, week_start, " + ", ".join(
    f"round(coalesce({c}, 0), 6) AS {c}" for c in WEEKLY_CLIMATE) + " FROM panel_wide"))
def fill_zero(v):
    return show(v.panel_wide.fillna(0, list(WEEKLY_CLIMATE)), ["district", "week_start"], WEEKLY_CLIMATE)


@query("align_columns", view("panel_wide", """
SELECT district, week_start, round(coalesce(T2M_avg, 0), 6) AS T2M_avg, CAST(coalesce(typhus, 0) AS DOUBLE) AS typhus,
  CAST(0 AS DOUBLE) AS not_there, round(coalesce(RH2M_max, 0), 6) AS RH2M_max FROM panel_wide"""))
def align_columns(v):
    df = tidy.align_columns(v.panel_wide, ["T2M_avg", "typhus", "not_there", "RH2M_max"], ["district", "week_start"])
    return show(df, ["district", "week_start"], ["T2M_avg", "typhus", "not_there", "RH2M_max"])


_LIMITS = {c: EXPECTED_RANGES[next(p for p in EXPECTED_RANGES if c.startswith(p))] for c in ("T2M_avg", "T2M_MAX_max", "RH2M_avg", "PRECTOTCORR_avg")}


def _outside(c, lo, hi):
    return " OR ".join([f"{c} < {lo}"] * (lo is not None) + [f"{c} > {hi}"] * (hi is not None))


@query("range_check", view("climate_weekly", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(min({c}), 6) AS lowest, round(max({c}), 6) AS highest,
  CAST(count(*) FILTER (WHERE {_outside(c, *_LIMITS[c])}) AS BIGINT) AS outside FROM climate_weekly""" for c in _LIMITS)))
def range_check(v):
    return show(tidy.range_check(v.climate_weekly, _LIMITS), ["column", "outside"], ["lowest", "highest"])


_RANGE_FEATURES = ["target", "T2M_avg", "T2M_MAX_max", "RH2M_avg", "PRECTOTCORR_avg"]


@query("train_range_check", view("panel", " UNION ALL ".join(
    f"""SELECT split, '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} < (SELECT min({c}) FROM panel WHERE split = 'train')
  OR {c} > (SELECT max({c}) FROM panel WHERE split = 'train')) AS BIGINT) AS outside FROM panel WHERE split <> 'train' GROUP BY split"""
    for c in _RANGE_FEATURES)))
def train_range_check(v):
    return tidy.train_range_check(v.panel, _RANGE_FEATURES)


_FINITE = ["target", "T2M_avg", "PRECTOTCORR_avg", "log_target"]


@query("finite_check", view("panel", " UNION ALL ".join(
    f"SELECT split, '{c}' AS feature, CAST(count(*) FILTER (WHERE {'target = 0' if c == 'log_target' else 'false'}) AS BIGINT) AS not_finite FROM panel GROUP BY split"
    for c in _FINITE)))
def finite_check(v):
    df = v.panel.withColumn("log_target", F.when(F.col("target") == 0, F.lit(float("-inf"))).otherwise(F.log("target")))
    return tidy.finite_check(df, _FINITE, ["split"])


@query("split_overlap_check", view("series", """
SELECT CAST(count(*) AS BIGINT) AS overlap FROM (SELECT district, week_number FROM series WHERE split = 'train'
  INTERSECT SELECT district, week_number FROM series WHERE split = 'test')"""))
def split_overlap_check(v):
    return joins.split_overlap(v.series, ["district", "week_number"], "train", "test")


@query("clip_nonneg", view("forecasts", "SELECT disease, district, week_start, round(greatest(a - b, 0), 6) AS clipped FROM forecasts"))
def clip_nonneg(v):
    return show(v.forecasts.withColumn("clipped", numbers.floor_zero(F.col("a") - F.col("b"))), KEY, ["clipped"])


@query("monsoon_label", view("panel", """
SELECT disease, district, week_start, CASE WHEN monsoon_IM2 THEN 'IM2' WHEN monsoon_SW THEN 'SW' WHEN monsoon_NE THEN 'NE' ELSE 'None' END AS monsoon_season
FROM panel"""))
def monsoon_label(v):
    return tidy.monsoon_label(v.panel).select(*KEY, "monsoon_season")


@query("derive_duration", view("climate_daily", """
SELECT district, CAST((d - first_day) // 7 AS BIGINT) AS block_week_id,
  strftime(min(d), '%Y-%m-%d') || ' to ' || strftime(max(d), '%Y-%m-%d') AS duration
FROM climate_daily JOIN (SELECT district, min(d) AS first_day FROM climate_daily GROUP BY district) USING (district) GROUP BY 1, 2"""))
def derive_duration(v):
    return block_weekly_climate(v.climate_daily).select("district", "block_week_id", "duration")


@query("display_rounding", view("forecasts", """
SELECT disease, district, week_start, round(a, 2) AS rounded,
  printf('%.2f (%d)', CAST(a AS DOUBLE), CAST(round_even(a, 0) AS BIGINT)) AS shown,
  printf('%.2f (%d - %d) cases', CAST(a AS DOUBLE), CAST(floor(a) AS BIGINT), CAST(ceil(a) AS BIGINT)) AS shown_range FROM forecasts"""))
def display_rounding(v):
    return v.forecasts.select(
        *KEY, F.round("a", 2).alias("rounded"), text.value_with_rounded("a").alias("shown"), text.value_with_bounds("a").alias("shown_range"))
