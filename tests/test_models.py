"""Learners, explanations, series operators without an SQL twin, the cache and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import explain, learn, profile, series
from weekloom.runtime import new_folder
from weekloom.sources import stores

NAMES = ["x0", "x1", "x2"]
KEYS = ["disease", "district", "week_start"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 1500
    x = rng.random((n, 3)) * 10
    y = 3 * x[:, 0] + x[:, 1] + rng.normal(0, 0.5, n)
    rows = [
        ("d", f"p{i % 5}", i, ["train", "train", "train", "val", "test"][(i // 5) % 5], float(y[i]), *map(float, x[i])) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "disease string, district string, week_start int, split string, target double, x0 double, x1 double, x2 double")
    return learn.assemble(df, NAMES, [*KEYS, "split", "target"]).cache()


@pytest.fixture(scope="module")
def boosted(table):
    return learn.boosted(table, maxIter=15)


def test_learners_beat_the_train_mean(table, boosted):
    train, rest = learn.splits_of(table)
    mean = train.agg(F.avg("target")).first()[0]
    base = rest.agg(F.avg(F.abs(F.col("target") - mean))).first()[0]
    for model in (boosted, learn.ridge(train), learn.tree(train)):
        mae = learn.scored(model, rest).agg(F.avg(F.abs(F.col("target") - F.col("p")))).first()[0]
        assert mae < base / 2


def test_importance_finds_the_signal(table, boosted):
    got = {r.feature: r.rise for r in explain.permutation_importance(boosted, table.filter("split = 'test'"), NAMES, NAMES, KEYS).collect()}
    assert got["x0"] > got["x1"] > got["x2"] - 0.05
    gains = boosted.featureImportances.toArray().tolist()
    assert learn.top_places(gains, NAMES, 0.5, 1) == [0] and learn.top_places(gains, NAMES, 0.5, 2)[:2] == [0, 1]


def test_pacf_of_an_ar1_series(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for e in rng.normal(size=1500):
        y.append(0.7 * y[-1] + e)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, t int, y double")
    got = {r.lag: r.pacf for r in series.pacf(series.acf(df, ["k"], "t", "y", 5), ["k"]).collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(0.7, abs=0.06) and abs(got[3]) < 0.08
    # Brute force: solve the Yule-Walker equations of order 4.
    a = {r.lag: r.acf for r in series.acf(df, ["k"], "t", "y", 5).collect()}
    m = np.array([[a[abs(i - j)] for j in range(4)] for i in range(4)])
    assert got[4] == pytest.approx(np.linalg.solve(m, [a[i] for i in range(1, 5)])[-1], abs=1e-9)


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.multivariate_normal([0, 1, 2], [[2, .5, 0], [.5, 1, .3], [0, .3, 1.5]], 400)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    d = x - x.mean(0)
    dist = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T, bias=True)), d)
    want = set(np.where(dist > np.quantile(dist, 0.95))[0])
    assert {r.i for r in profile.multivariate_anomaly(df, ["a", "b", "c"]).collect()} == want


def test_corr_matrix_skips_nulls_per_pair(spark):
    rng = np.random.default_rng(9)
    import pandas as pd

    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    pdf["b"] += 1000 + pdf["a"]
    pdf.loc[::4, "b"] = None
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    got = {(r.left, r.right): r.corr for r in profile.corr_matrix(df, list("abc")).collect()}
    want = pdf.corr()
    assert all(got[i, j] == pytest.approx(want.loc[i, j], abs=1e-9) for i in "abc" for j in "abc")


def test_cache_rewrite_is_idempotent(spark):
    path = new_folder(spark, "cache-test")
    df = spark.sql("SELECT id, date_add(DATE'2024-01-01', CAST(id % 3 * 7 AS INT)) AS week_start FROM range(30)")
    for _ in range(2):
        stores.write_weeks(df, path)
    assert spark.read.parquet(path).count() == 30
    one = df.filter("week_start = DATE'2024-01-08'").limit(4)
    stores.write_weeks(one, path)
    assert spark.read.parquet(path).count() == 24


def _streamed(spark, rows, order, files=4):
    """The stream's table over files in the given order, with its late report."""
    from weekloom.streaming import weekly as stream

    source, path, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    live = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    days = rows.select(F.percentile(F.unix_seconds("ts"), F.array(*[F.lit(k / files) for k in range(files + 1)])).alias("q")).first().q
    for k in order(range(files)):
        low, high = days[k], days[k + 1] + (k == files - 1)
        rows.filter((F.unix_seconds("ts") >= low) & (F.unix_seconds("ts") < high)).coalesce(1).write.mode("append").parquet(source)
        stream.run_to_table(live(), path, state)
    stream.run_to_table(live(), path, state)  # nothing new
    return path, stream.read_table(spark, path), stream.late_rows(spark, path)


def _same_weeks(got, rows):
    from weekloom.operators.weekly import weekly_climate

    r = lambda d: d.select("district", "week_start", *[F.round(c, 6).alias(c) for c in sorted(d.columns) if c.startswith(("T2M", "RH2M", "PREC"))])
    got, want = r(got), r(weekly_climate(rows, "ts"))
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_stream_over_several_batches_equals_batch(spark, views):
    from weekloom.functions.dates import utc_instant

    rows = views.readings.withColumn("ts", utc_instant("ts")) if dict(views.readings.dtypes)["ts"] == "timestamp_ntz" else views.readings
    for order, some_late in ((list, False), (lambda x: list(reversed(x)), True)):
        path, got, late = _streamed(spark, rows, order)
        _same_weeks(got, rows)
        report = late.orderBy("batch").collect()
        assert len(report) == 4 and sum(r.rows for r in report) == rows.count()
        assert (sum(r.late for r in report) > 0) == some_late and report[0].late == 0


def test_stream_retry_nulls_and_compaction(spark):
    from weekloom.streaming import weekly as stream

    rows = spark.sql("""SELECT CAST(a AS string) AS district, CAST(t AS timestamp) AS ts, CAST(x AS double) AS T2M, 1.0D AS T2M_MAX, 1.0D AS T2M_MIN,
        CAST(NULL AS double) AS RH2M, 2.0D AS PRECTOTCORR FROM VALUES ('p', '2024-01-07 23:59:59', 1), ('p', '2024-01-08 00:00:00', 2), ('p', '2024-01-08 01:00:00', 4),
        (NULL, '2024-01-08 00:00:00', 5), ('q', NULL, 6), ('q', '2024-01-01 00:00:00', NULL) AS v(a, t, x)""")
    path, target = new_folder(spark, "parts"), new_folder(spark, "merged")
    for batch, part in ((0, rows.filter("T2M > 1 OR T2M IS NULL")), (1, rows.filter("T2M = 1")), (1, rows.filter("T2M = 1"))):  # the last is a retry
        stream.weekly_parts(part).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    want = [("p", "2024-01-01", 1.0, 1.0, None), ("p", "2024-01-08", 3.0, 4.0, None), ("q", "2024-01-01", None, None, None)]
    stream.compact(spark, path, target)
    for folder in (path, target):
        got = stream.read_table(spark, folder).select("district", F.col("week_start").cast("string"), "T2M_avg", "T2M_max", "RH2M_avg")
        assert sorted(map(tuple, got.collect())) == want
    assert {(r.batch, r.rows, r.late) for r in stream.late_rows(spark, path).collect()} == {(0, 3, 0), (1, 1, 0)}
    assert {(r.batch, r.late) for r in stream.late_rows(spark, path, "0 days").collect()} == {(0, 0), (1, 1)}


def test_ema_over_range_cells(spark):
    rng = np.random.default_rng(2)
    long = [("long", i, float(x)) for i, x in enumerate(rng.normal(size=100_000))]
    odd = [("odd", 7, None), ("odd", 3, 2.0), ("odd", 1, None), ("odd", 9, 5.0), ("odd", 12, 1.0), ("odd", 4, 4.0), ("one", 1, 3.0), ("none", 1, None)]
    many = [(f"k{i % 40}", i, None if i % 17 == 0 else float(i % 13)) for i in range(3000)]
    rows = long + odd + many
    got = {(r.g, r.i): r.ema for r in series.ema(spark.createDataFrame(rows, "g string, i int, v double").repartition(6), ["g"], "i", "v").collect()}
    assert len(got) == len(rows)
    last = {}
    for g, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        e = last.get(g)
        last[g] = e = None if v is None else v if e is None else 0.88 * e + 0.12 * v
        assert got[g, i] == (None if e is None else pytest.approx(e, abs=1e-9)), (g, i)
    assert series.ema(spark.createDataFrame([], "g string, i int, v double"), ["g"], "i", "v").count() == 0


def test_correlations_of_large_values_do_not_cancel(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(4000, 3)), columns=list("abc"))
    pdf["b"] = 1e9 + pdf["a"] + pdf["b"]
    pdf["c"] = -3e9 + pdf["c"] * 0.5 + pdf["a"]
    pdf.loc[::5, "c"] = None
    pdf["d"], pdf["e"] = 7.0, None
    df = spark.createDataFrame(pdf.astype(float)).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcde"]).repartition(9)
    got = {(r.left, r.right): r.corr for r in profile.corr_matrix(df, list("abcde")).collect()}
    want = (pdf - pdf.mean()).corr()
    assert len(got) == 25
    for i in "abc":
        for j in "abc":
            assert got[i, j] == pytest.approx(want.loc[i, j], abs=1e-6)
        assert got[i, "d"] is None and got["e", i] is None
