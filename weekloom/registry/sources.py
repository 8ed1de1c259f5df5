"""Queries over sources and sinks: each writes rows derived from the tables, then reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.constants import CLIMATE_VARIABLES, DAILY_SOURCE_COORDINATES, DISEASES, READING_SOURCE_COORDINATES
from weekloom.functions.dates import epoch_seconds, week_start
from weekloom.operators import weekly
from weekloom.registry.base import out, query, show
from weekloom.registry.sql import view
from weekloom.runtime import new_folder
from weekloom.sources import csv, payloads, stores

CLIMATE = list(CLIMATE_VARIABLES)


@query("scan_csv", view("climate_daily", f"SELECT {out(['district', 'd'], CLIMATE)} FROM climate_daily"))
def scan_csv(v):
    path = new_folder(v.spark, "daily")
    v.climate_daily.select("district", "d", *CLIMATE).write.option("header", True).csv(path)
    return show(csv.scan_csv(v.spark, path, csv.DAILY_CLIMATE), ["district", "d"], CLIMATE)


@query("trim_headers", view("cases_weekly", "SELECT district, week_start, disease, target FROM cases_weekly"))
def trim_headers(v):
    path = new_folder(v.spark, "headers")
    blank = v.cases_weekly.toDF(*[f" {c} " for c in v.cases_weekly.columns])
    blank.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = csv.trim_headers(csv.scan_named(v.spark, path))
    return df.select("district", F.to_date("week_start").alias("week_start"), "disease", F.col("target").cast("bigint").alias("target"))


@query("drop_unnamed", view("cases_weekly", "SELECT district, week_start, disease, target FROM cases_weekly"))
def drop_unnamed(v):
    path = new_folder(v.spark, "unnamed")
    v.cases_weekly.withColumns({"Unnamed: 0": F.lit(""), "Unnamed: 5": F.col("target")}).write.option("header", True).csv(path)
    df = csv.drop_unnamed(csv.scan_named(v.spark, path))
    return df.select(
        *[c for c in df.columns if c not in ("week_start", "target")],
        F.to_date("week_start").alias("week_start"), F.col("target").cast("bigint").alias("target"),
    )


@query("scan_report_files", view("cases_wide", "SELECT district, week_start AS start_date, CAST(week_start + 6 AS DATE) AS end_date, "
                                 + ", ".join(DISEASES) + " FROM cases_wide"))
def scan_report_files(v):
    from weekloom.operators.weekly import count_weekly_wide

    path = new_folder(v.spark, "reports")
    day = lambda n: F.date_format(F.date_add("week_start", n), "yyyy-MM-dd")
    reports = count_weekly_wide(v.cases_daily).withColumn("report", F.concat(day(7), F.lit("_to_"), day(13)))
    reports.drop("week_start").hint("rebalance", "report").write.partitionBy("report").option("header", True).csv(path)
    schema = "district string, " + ", ".join(f"{d} bigint" for d in DISEASES)
    return csv.scan_report_files(v.spark, path, schema)


@query("tolerant_scan", view("cases_weekly", """
SELECT district, CAST(count(*) FILTER (WHERE target <> 3) AS BIGINT) AS good_rows,
  CAST(sum(target) FILTER (WHERE target <> 3) AS BIGINT) AS good_cases,
  CAST(count(*) FILTER (WHERE target = 3) AS BIGINT) AS bad_rows FROM cases_weekly GROUP BY district"""))
def tolerant_scan(v):
    path = new_folder(v.spark, "tolerant")
    number = F.when(F.col("target") == 3, "n/a").otherwise(F.col("target").cast("string"))
    line = F.concat_ws(",", "district", F.col("week_start").cast("string"), "disease", number)
    v.cases_weekly.select(line.alias("value")).write.text(path)
    good, bad, _ = csv.tolerant_scan(v.spark, path, "district string, week_start date, disease string, target bigint")
    lost = bad.groupBy(F.split("line", ",")[0].alias("district")).agg(F.count("*").alias("bad_rows"))
    kept = good.groupBy("district").agg(F.count("*").alias("good_rows"), F.sum("target").alias("good_cases"))
    return kept.join(lost, "district", "left").withColumn("bad_rows", F.coalesce("bad_rows", F.lit(0).cast("bigint")))


@query("json_param_series", view("climate_daily", "SELECT district, d, "
    + out((), ["T2M", "T2M_MAX", "T2M_MIN"]) + """,
  CASE WHEN weekofyear(d) % 2 = 1 THEN round(RH2M, 6) END AS RH2M, round(PRECTOTCORR, 6) AS PRECTOTCORR FROM climate_daily"""))
def json_param_series(v):
    # One payload per district and week holds at most seven days.
    series = lambda c: F.map_from_entries(F.collect_list(F.struct(F.date_format("d", "yyyyMMdd"), c)))
    weeks = v.climate_daily.groupBy("district", week_start("d").alias("w")).agg(*[series(c).alias(c) for c in CLIMATE])
    entry = lambda c: F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))
    every = F.array(*[entry(c) for c in CLIMATE])
    no_humidity = F.array(*[entry(c) for c in CLIMATE if c != "RH2M"])
    parameter = F.map_from_entries(F.when(F.weekofyear("w") % 2 == 1, every).otherwise(no_humidity))
    sent = weeks.select("district", F.to_json(F.struct(F.struct(parameter.alias("parameter")).alias("properties"))).alias("payload"))
    return show(payloads.daily_series(sent), ["district", "d"], CLIMATE)


@query("json_reading_list", view("readings", """
SELECT event_id, district, CAST(ts AS DATE) AS d, 1 AS item, round(T2M, 6) AS T2M, round(T2M_MAX, 6) AS T2M_MAX, round(T2M_MIN, 6) AS T2M_MIN,
  round(RH2M, 6) AS RH2M, round(CASE WHEN event_id % 3 = 0 THEN PRECTOTCORR * 3 WHEN event_id % 3 = 1 THEN PRECTOTCORR ELSE 0 END, 6) AS PRECTOTCORR FROM readings
UNION ALL
SELECT event_id, district, CAST(ts + INTERVAL 3 HOUR AS DATE), 2, round(T2M, 6), round(T2M, 6), round(T2M, 6), round(RH2M, 6), 0.0 FROM readings"""))
def json_reading_list(v):
    seconds = epoch_seconds("ts")
    k = F.col("event_id") % 3
    nothing = F.lit(None).cast("double")
    rain = F.struct(
        F.when(k == 0, 0.0).when(k == 1, F.col("PRECTOTCORR")).alias("1h"),
        F.when(k == 0, F.col("PRECTOTCORR") * 3).alias("3h"),
    )
    main = lambda hi, lo: F.struct(
        F.col("T2M").alias("temp"), hi.alias("temp_max"), lo.alias("temp_min"), F.col("RH2M").alias("humidity"))
    none = F.struct(nothing.alias("1h"), nothing.alias("3h"))
    items = F.array(
        F.struct(seconds.alias("dt"), main(F.col("T2M_MAX"), F.col("T2M_MIN")).alias("main"), rain.alias("rain")),
        F.struct((seconds + 10800).alias("dt"), main(nothing, nothing).alias("main"), F.when(k < 0, none).alias("rain")),
    )
    sent = v.readings.select("event_id", "district", F.to_json(F.struct(items.alias("list"))).alias("payload"), F.col("ts").cast("date").alias("day0"))
    df = payloads.reading_list(sent)
    item = F.when(F.col("T2M_MAX") > F.col("T2M"), 1).otherwise(2)
    return show(df.withColumn("item", item), ["event_id", "district", "d", "item"], CLIMATE)


@query("json_current", view("readings", """
SELECT event_id, district, CAST(ts AS DATE) AS d, event_type AS description, round(T2M, 6) AS T2M, round(T2M_MAX, 6) AS T2M_MAX,
  round(T2M_MIN, 6) AS T2M_MIN, round(RH2M, 6) AS RH2M, CASE WHEN event_id % 2 = 0 THEN round(PRECTOTCORR, 6) ELSE 0.0 END AS PRECTOTCORR FROM readings"""))
def json_current(v):
    rain = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("PRECTOTCORR").alias("1h")))
    main = F.struct(F.col("T2M").alias("temp"), F.col("T2M_MAX").alias("temp_max"), F.col("T2M_MIN").alias("temp_min"), F.col("RH2M").alias("humidity"))
    doc = F.struct(
        epoch_seconds("ts").alias("dt"), main.alias("main"), rain.alias("rain"),
        F.array(F.struct(F.col("event_type").alias("description"))).alias("weather"),
    )
    df = payloads.current_reading(v.readings.select("event_id", "district", F.to_json(doc).alias("payload")))
    return show(df, ["event_id", "district", "d", "description"], CLIMATE)


_PLACES = ", ".join(
    f"('{s}', '{n}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE), {i})"
    for s, d in (("daily", DAILY_SOURCE_COORDINATES), ("readings", READING_SOURCE_COORDINATES))
    for i, (n, (lat, lon)) in enumerate(sorted(d.items()))
)


@query("district_dim", view("cases_daily", f"""
SELECT source, p.district, lat, lon, CAST(n AS BIGINT) AS cases FROM (VALUES {_PLACES}) p(source, district, lat, lon, code)
JOIN (SELECT e.code, n FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS code FROM nation) e
      JOIN (SELECT district, count(*) AS n FROM cases_daily GROUP BY district) c ON c.district = e.n_name) q USING (code)"""))
def district_dim(v):
    # 2 x 25 fixed rows: small by construction, matched to the data's districts by alphabetical rank.
    names = sorted(DAILY_SOURCE_COORDINATES)
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("district")) - 1
    dim = stores.district_dimension(v.spark).withColumn("district_enc", code)
    totals = v.cases_daily.groupBy("district").agg(F.count("*").alias("cases")).join(v.codes, "district").drop("district")
    return totals.join(F.broadcast(dim), "district_enc").select("source", "district", "lat", "lon", "cases")


@query("week_cache_read", view("climate_weekly", """
SELECT district, week_start, CASE WHEN weekofyear(week_start) % 2 = 0 THEN 'cache' ELSE 'computed' END AS source,
  round(T2M_avg, 6) AS T2M_avg FROM climate_weekly"""))
def week_cache_read(v):
    from weekloom.functions.dates import week_start

    cache = stores.WeekCache(v.spark, new_folder(v.spark, "cache"))
    day = week_start(F.col("l_shipdate").cast("date"))
    wanted = v.table("lineitem").agg(F.min(day).alias("a"), F.max(day).alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week_start"))

    def compute(weeks):
        """Only the raw days of these weeks."""
        days = v.climate_daily.filter(week_start("d").isin(weeks))
        return weekly.weekly_climate(days).select("district", "week_start", "T2M_avg")

    cache.fill(wanted.filter(F.weekofyear("week_start") % 2 == 0), compute)
    return show(cache.read(wanted, compute), ["district", "week_start", "source"], ["T2M_avg"])


@query("week_cache_write", view("climate_weekly", """
SELECT week_start, CAST(count(*) AS BIGINT) AS districts, round(sum(T2M_avg + CASE WHEN weekofyear(week_start) % 4 = 0 THEN 1 ELSE 0 END), 6) AS T2M_sum
FROM climate_weekly GROUP BY week_start"""))
def week_cache_write(v):
    path = new_folder(v.spark, "cache")
    weekly = v.climate_weekly.select("district", "week_start", "T2M_avg")
    stores.write_weeks(weekly, path)
    changed = weekly.filter(F.weekofyear("week_start") % 4 == 0).withColumn("T2M_avg", F.col("T2M_avg") + 1)
    for _ in range(2):  # writing the same weeks twice must not double them
        stores.write_weeks(changed, path)
    df = v.spark.read.parquet(path).groupBy(F.col("week_start").cast("date").alias("week_start"))
    return show(df.agg(F.count("*").alias("districts"), F.sum("T2M_avg").alias("T2M_sum")), ["week_start", "districts"], ["T2M_sum"])


@query("sink_csv", view("series", "SELECT disease, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(target) AS BIGINT) AS cases FROM series GROUP BY disease, split"))
def sink_csv(v):
    path = new_folder(v.spark, "splits")
    stores.write_split_tables(v.series, path, "csv")
    back = csv.scan_csv(v.spark, path, "district string, week_start date, week_index bigint, target bigint, week_number int, disease string, split string")
    return back.groupBy("disease", "split").agg(F.count("*").alias("n"), F.sum("target").alias("cases"))


@query("sink_subset", view("climate_daily", f"SELECT {out(['d', 'district'], ['T2M', 'RH2M'])} FROM climate_daily"))
def sink_subset(v):
    path = new_folder(v.spark, "subset")
    known = ["d", "T2M", "RH2M", "WS2M", "district"]
    csv.keep_known(v.climate_daily.drop("PRECTOTCORR"), known).write.option("header", True).csv(path)
    return show(csv.scan_csv(v.spark, path, "d date, T2M double, RH2M double, district string"), ["d", "district"], ["T2M", "RH2M"])


_METRIC_SQL = """SELECT disease, round(avg(abs(target - a)), 6) AS mae, round(sqrt(avg((target - a) * (target - a))), 6) AS rmse,
  CAST(count(*) AS BIGINT) AS n FROM forecasts WHERE split = 'test' GROUP BY disease"""


def _metrics(v):
    e = F.col("target") - F.col("a")
    return v.forecasts.filter("split = 'test'").groupBy("disease").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


@query("sink_json", view("forecasts", _METRIC_SQL))
def sink_json(v):
    path = new_folder(v.spark, "metrics")
    stores.export_json(_metrics(v), path)
    return show(v.spark.read.schema("disease string, mae double, rmse double, n bigint").json(path), ["disease", "n"], ["mae", "rmse"])


@query("read_metrics", view("forecasts", _METRIC_SQL))
def read_metrics(v):
    path = new_folder(v.spark, "metrics")
    df = _metrics(v).select(F.col("disease").alias("_c0"), "mae", "rmse", "n")
    df.write.option("header", True).csv(path)
    back = csv.scan_csv(v.spark, path, "disease string, mae double, rmse double, n bigint")
    return show(back, ["disease", "n"], ["mae", "rmse"])


_WIDE = ["district", "week_start", "week_index", *DISEASES]


@query("verify_export", view("panel_cases", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM panel_cases" for c in _WIDE)))
def verify_export(v):
    path = new_folder(v.spark, "export")
    v.panel_cases.select(*_WIDE).write.parquet(path)
    return stores.null_profile(v.spark.read.parquet(path)).select("column", "rows", "nulls")
