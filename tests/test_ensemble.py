"""The per-disease chain, its store, forest quantiles, staged curves and contributions, against brute force and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weekloom.operators import ensemble, explain, learn
from weekloom.operators.ensemble import Setting
from weekloom.runtime import new_folder
from weekloom.sources.models import ModelStore

NAMES = ["x0", "x1", "x2", "x3"]
KEYS = ["disease", "district", "week_start"]
SETTINGS = {"d": Setting(3, 0.8, 1.0, 5, 40, patience=10, trees=6), "e": Setting(2, 0.8, 1.0, 5, 6, 3, patience=2, bias=False, trees=5), "none": Setting(2, 0.8, 1.0, 5, 6)}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 1000
    x = rng.random((n, 4)) * 10
    y = np.round(3 * x[:, 0] + x[:, 1] + rng.normal(0, 1, n) + 5)
    rows = [("de"[i % 2], f"p{i % 5}", i, ["train", "train", "train", "val", "test"][(i // 10) % 5], float(y[i] * (1 + i % 2)), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "disease string, district string, week_start int, split string, target double, x0 double, x1 double, x2 double, x3 double")
    return learn.assemble(df, NAMES, [*KEYS, "split", "target"]).cache()


@pytest.fixture(scope="module")
def store(spark, table):
    s = ModelStore(spark, new_folder(spark, "store"))
    assert s.listed() == {}
    ensemble.fit_all(table, NAMES, s, settings=SETTINGS)
    return s


def test_store_keeps_whole_models(table, store):
    listed = store.listed()
    assert set(listed) == {(d, p) for d in "de" for p in ("boosted", "boosted_all", "forest")}
    assert all(r["features"] == NAMES for r in listed.values())
    for (d, p), r in listed.items():
        assert store.load(d, p).getNumTrees == (r["facts"]["rounds"] if p != "boosted_all" else store.load(d, p).getNumTrees)
    before = store.load("d", "forest")
    ensemble.fit_all(table, NAMES, store, settings=SETTINGS)  # nothing is missing
    assert store.load("d", "forest").uid == before.uid
    with pytest.raises(LookupError):
        ensemble.predicted(table, store, "other", KEYS)


def test_stop_round():
    assert ensemble.stop_round([5, 4, 3, 3.5, 3.2, 2], 2) == (3, True)
    assert ensemble.stop_round([5, 4, 3, 3.5, 2], 2) == (5, False)
    assert ensemble.stop_round([5, 5, 5], 2) == (1, True)


def test_rounds_stay_inside_the_limits(store):
    facts = {k: r["facts"]["rounds"] for k, r in store.listed().items()}
    assert 1 <= facts["d", "boosted"] <= 40 and 3 <= facts["e", "boosted"] <= 6


def test_more_rounds_begin_with_the_same_trees(store):
    stop, tried = store.load("d", "boosted"), store.load("d", "boosted_all")
    assert [t.toDebugString.split("\n", 1)[1] for t in tried.trees[:stop.getNumTrees]] == [t.toDebugString.split("\n", 1)[1] for t in stop.trees]


def test_predictions_beat_the_mean(table, store):
    held = table.filter("split <> 'train'")
    for part in ensemble.LEARNERS:
        p = ensemble.predicted(held, store, part, [*KEYS, "target"])
        assert p.count() == held.count()
        errors = {r.disease: (r.mae, r.base) for r in p.groupBy("disease").agg(
            F.avg(F.abs(F.col("target") - F.col("p"))).alias("mae"), F.avg(F.abs(F.col("target") - 30)).alias("base")).collect()}
        assert all(mae < base for mae, base in errors.values())


def brute_quantiles(model, train, rows, probs):
    """Weights of every train row for every row, by the definition."""
    leaves = lambda d: np.array([list(r.l) for r in model.setLeafCol("leaf").transform(d).select(vector_to_array("leaf").alias("l")).collect()])
    a, b = leaves(train), leaves(rows)
    y = np.array([r.target for r in train.select("target").collect()])
    out = []
    for leaf in b:
        same = a == leaf
        w = (same / same.sum(axis=0)).mean(axis=1)
        order = np.argsort(y, kind="stable")
        c = np.cumsum(w[order])
        out.append([y[order][np.argmax(c >= p - 1e-9)] for p in probs])
    return out


def test_forest_quantiles_equal_brute_force(table, store):
    rows = table.filter("disease = 'd'").orderBy("week_start")
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    model = store.load("d", "forest")
    got = ensemble.forest_quantiles(model, train, rest, {"lower": 0.05, "median": 0.5, "upper": 0.95}, KEYS).orderBy("week_start").collect()
    assert [[r.lower, r.median, r.upper] for r in got] == brute_quantiles(model, train, rest, [0.05, 0.5, 0.95])


def test_curve_equals_the_rounds_scored_one_by_one(table, store):
    for part, name in (("boosted", "boosted_all"), ("forest", "forest")):
        curve = {(r.disease, r.split, r.round): r for r in ensemble.staged_errors(table, store, part, KEYS).collect()}
        for d in "de":
            model = store.load(d, name)
            assert sum(r.stop for r in curve.values() if r.disease == d) == 3
            for split in ("train", "val", "test"):
                rows = table.filter(F.col("disease") == d).filter(F.col("split") == split)
                mine = [curve[d, split, k + 1] for k in range(model.getNumTrees)]
                assert sum(r.best for r in mine) == 1
                y = np.array([r.target for r in rows.select("target").collect()])
                trees = np.array([[r[-1] for r in t.transform(rows).collect()] for t in model.trees])
                if part == "boosted":
                    p = np.cumsum(trees * np.array(model.treeWeights)[:, None], axis=0)
                else:
                    p = np.cumsum(trees, axis=0) / np.arange(1, len(trees) + 1)[:, None]
                p = np.maximum(p, 0)
                assert [r.mae for r in mine] == pytest.approx(np.abs(y - p).mean(axis=1).tolist(), rel=1e-9)
                assert [r.rmse for r in mine] == pytest.approx(np.sqrt(((y - p) ** 2).mean(axis=1)).tolist(), rel=1e-9)


CHAIN_SQL = """
WITH w AS (SELECT disease, greatest(0.01, least(0.99, coalesce(sum((target - b) * (a - b)) / nullif(sum((a - b) ** 2), 0), 0.5))) AS weight
  FROM parts WHERE split = 'val' GROUP BY disease),
r AS (SELECT p.*, weight, greatest(a * weight + b * (1 - weight), 0) AS raw, greatest(a_lower * weight + b_lower * (1 - weight), 0) AS l,
  greatest(a_upper * weight + b_upper * (1 - weight), 0) AS u FROM parts p JOIN w USING (disease)),
f AS (SELECT disease, district, greatest(0.3, least(4.0, quantile_cont(CASE WHEN raw > 0.5 THEN target / raw ELSE 1.0 END, 0.5))) AS k
  FROM r WHERE split = 'val' AND disease = 'd' GROUP BY ALL),
o AS (SELECT r.*, raw * coalesce(k, 1) AS median, least(l, raw) * coalesce(k, 1) AS lower, greatest(u, raw) * coalesce(k, 1) AS upper
  FROM r LEFT JOIN f USING (disease, district))
SELECT disease, avg(abs(target - median)), sqrt(avg((target - median) ** 2)), avg(abs(target - a)), avg(abs(target - b)),
  avg(CAST(target BETWEEN lower AND upper AS INT)), avg(upper - lower), count(*)
FROM o WHERE split = 'test' GROUP BY disease ORDER BY disease
"""


def test_chain_over_stored_predictions_equals_sql(spark, table, store):
    path = new_folder(spark, "parts")
    ensemble.learner_intervals(table, store, KEYS, [*KEYS, "split", "target"]).write.parquet(path)
    got = ensemble.metrics(ensemble.blended(spark.read.parquet(path), SETTINGS)).orderBy("disease").collect()
    want = duckdb.sql(CHAIN_SQL.replace("parts", f"read_parquet('{path}/*.parquet')", 1).replace("parts p", f"read_parquet('{path}/*.parquet') p")).fetchall()
    assert len(got) == 2
    for g, w in zip(got, want):
        assert [g.disease, g.mae_blend, g.rmse_blend, g.mae_boosted, g.mae_forest, g.coverage, g.width, g.n] == [
            w[0], *[pytest.approx(x, rel=1e-9) for x in w[1:7]], w[7]]


def test_contributions_add_up_to_the_forecast(table, store):
    rows = table.filter("disease = 'd' AND split = 'test'").limit(20)
    model = store.load("d", "boosted")
    reference = explain.background(table.filter("disease = 'd' AND split = 'train'"), 3)
    parts = explain.shapley(model, rows, reference, NAMES, KEYS, pairs=3)
    assert parts.count() == 20 * len(NAMES)
    total = parts.groupBy(*KEYS, "base", "forecast").agg(F.sum("contribution").alias("c"))
    assert total.filter(F.abs(F.col("base") + F.col("c") - F.col("forecast")) > 1e-9).count() == 0
    scored = {r.week_start: r.p for r in model.transform(rows).select("week_start", "p").collect()}
    assert all(r.forecast == pytest.approx(scored[r.week_start]) for r in parts.collect())


def test_contributions_of_a_linear_model(table):
    train = table.filter("disease = 'd' AND split = 'train'")
    model = learn.ridge(train)
    reference = explain.background(train, 2)
    rows = table.filter("disease = 'd' AND split = 'val'").limit(5)
    mean, k = np.mean(reference, axis=0), model.coefficients.toArray()
    x = {r.week_start: np.array(list(r.x)) for r in rows.select("week_start", vector_to_array("features").alias("x")).collect()}
    for r in explain.shapley(model, rows, reference, NAMES, KEYS, pairs=2).collect():
        j = NAMES.index(r.feature)
        assert r.contribution == pytest.approx(k[j] * (x[r.week_start][j] - mean[j]), abs=1e-9)


def test_orders_come_in_reversed_pairs():
    places = explain.orders(7, 3)
    assert len(places) == 6 and all(sorted(p) == list(range(7)) for p in places)
    assert all(a == [6 - x for x in b] for a, b in zip(places[::2], places[1::2]))


def test_search_keeps_the_better_half(table):
    sets = {"good": (4, 0.1, 0.9, 1.0), "slow": (1, 0.0001, 0.9, 1.0), "middle": (2, 0.02, 0.9, 1.0), "slower": (1, 0.00001, 0.9, 1.0)}
    rows = ensemble.named_search(table, sets, rounds=4, diseases=("d", "e", "none"))
    assert {r[0] for r in rows} == {"d", "e"} and len(rows) == 8
    assert [(r[1], r[4]) for r in rows if r[5]] == [("good", 2), ("good", 2)]
    assert {r[1] for r in rows if r[4] == 1} == {"slow", "slower"}


def test_slim_vectors(table):
    slim = learn.sliced(table, {"d": [2, 0], "e": [1]}).select("disease", vector_to_array("features").alias("s"))
    whole = table.select("disease", vector_to_array("features").alias("x"))
    for a, b in zip(slim.collect(), whole.collect()):
        assert list(a.s) == ([b.x[2], b.x[0]] if b.disease == "d" else [b.x[1]])


def test_empty_table(spark, table):
    empty = ModelStore(spark, new_folder(spark, "empty-store"))
    ensemble.fit_all(table.limit(0), NAMES, empty, settings=SETTINGS)
    assert empty.listed() == {}
    with pytest.raises(LookupError):
        ensemble.staged_errors(table, empty, "boosted", KEYS)
