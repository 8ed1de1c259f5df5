"""Files that cannot be read, reports with odd names, the week cache, and means by level."""

import gzip
import os
from datetime import date, timedelta

from pyspark.sql import functions as F

from weekloom.operators import joins
from weekloom.runtime import new_folder
from weekloom.sources import csv, stores

SCHEMA = "district string, n bigint"


def _write(folder, name, data):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def _local(spark, label):
    return new_folder(spark, label).removeprefix("file://").removeprefix("file:")


def test_corrupt_files_and_lines_are_listed(spark):
    folder = _local(spark, "tolerant")
    _write(folder, "good one+two.csv", b"p,1\nq,2\n")
    _write(folder, "deep/more.csv.gz", gzip.compress(b"r,3\nbad,x\n"))
    _write(folder, "broken.csv.gz", b"this is not gzip")
    _write(folder, "nothing.csv", b"")
    good, bad, files = csv.tolerant_scan(spark, folder, SCHEMA)
    assert sorted(map(tuple, good.collect())) == [("p", 1), ("q", 2), ("r", 3)]
    assert [(r.line, r.path.rsplit("/", 1)[1]) for r in bad.collect()] == [("bad,x", "more.csv.gz")]
    assert [(r.path.rsplit("/", 1)[1], r.bytes) for r in files.collect()] == [("broken.csv.gz", 16)]


def test_stray_reports_do_not_stop_the_scan(spark):
    folder = _local(spark, "reports")
    _write(folder, "2024-01-08_to_2024-01-14.csv", b"district,n\np,1\n")
    _write(folder, "sub/2024-01-15_to_2024-01-21.csv", b"district,n\np,2\n")
    _write(folder, "2024-01-15_to_2024-13-41.csv", b"district,n\np,8\n")
    _write(folder, "notes.csv", b"district,n\nz,9\n")
    got = csv.scan_report_files(spark, folder, SCHEMA).select("n", F.col("start_date").cast("string"), F.col("end_date").cast("string"))
    assert sorted(map(tuple, got.collect())) == [(1, "2024-01-01", "2024-01-07"), (2, "2024-01-08", "2024-01-14")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in csv.stray_reports(spark, folder).collect()) == ["2024-01-15_to_2024-13-41.csv", "notes.csv"]


def test_a_full_cache_reads_no_raw_file(spark):
    raw = new_folder(spark, "raw")
    spark.sql("SELECT 'p' AS district, date_add(DATE'2024-01-01', CAST(id AS INT)) AS d, id AS x FROM range(60)").write.parquet(raw)
    cache = stores.WeekCache(spark, new_folder(spark, "cache"))
    monday = date(2024, 1, 1)
    wanted = lambda *ks: spark.createDataFrame([(monday + timedelta(weeks=k),) for k in ks], "week_start date")
    asked = []

    def compute(weeks):
        asked.append(weeks)
        rows = spark.read.parquet(raw).withColumn("week_start", F.date_trunc("week", "d").cast("date"))
        return rows.filter(F.col("week_start").isin(weeks)).groupBy("district", "week_start").agg(F.sum("x").alias("x"))

    totals = {k: sum(i for i in range(60) if i // 7 == k) for k in range(9)}
    got = lambda df: sorted(((r.week_start - monday).days // 7, r.x, r.source) for r in df.collect())
    assert got(cache.read(wanted(0, 2, 2), compute)) == [(0, totals[0], "computed"), (2, totals[2], "computed")]
    assert got(cache.read(wanted(0, 1, 50), compute)) == [(0, totals[0], "cache"), (1, totals[1], "computed")]
    full = cache.read(wanted(0, 1, 2, 50), compute)  # week 50 has no rows and is listed all the same
    assert got(full) == [(k, totals[k], "cache") for k in (0, 1, 2)]
    assert asked == [[monday, monday + timedelta(weeks=2)], [monday + timedelta(weeks=1), monday + timedelta(weeks=50)]]
    assert raw.rsplit("/", 1)[1] not in full._jdf.queryExecution().toString()


def test_cache_of_weeks_without_rows(spark):
    cache = stores.WeekCache(spark, new_folder(spark, "cache"))
    wanted = spark.createDataFrame([(date(2024, 1, 1),)], "week_start date")
    compute = lambda weeks: spark.sql("SELECT 'p' AS district, DATE'2020-01-06' AS week_start, 1 AS x WHERE false")
    assert cache.read(wanted, compute).count() == 0 == len(cache.missing(wanted))


def test_means_by_level_keep_to_their_disease(spark):
    train = spark.createDataFrame([("a", "p", 1, 10.0), ("a", "q", 1, 20.0), ("a", "q", 2, 40.0), ("b", "p", 1, 1.0), ("b", "p", 1, None)], "disease string, district string, week_number int, target double")
    keys = [("a", "p", 1), ("a", "r", 1), ("a", "p", 9), ("b", "q", 9), ("c", "p", 1)]
    df = spark.createDataFrame(keys, "disease string, district string, week_number int")
    out = joins.hierarchical_mean(df, train, ["disease", "district", "week_number"], ["disease", "week_number"])
    got = {(r.disease, r.district, r.week_number): r.seasonal_mean for r in out.collect()}
    assert got == {keys[0]: 10.0, keys[1]: 15.0, keys[2]: 27.5, keys[3]: 1.0, keys[4]: None}
