"""Order statistics and running sums against brute force, with hot groups and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekloom.operators import drift, rank


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "b", "c"], n, p=[0.9, 0.07, 0.03]),
        "v": np.where(rng.random(n) < 0.35, 0.0, rng.gamma(2.0, 3.0, n).round(3)),
        "k": np.arange(n),
        "split": rng.choice(["train", "val", "test"], n, p=[0.6, 0.2, 0.2]),
    })
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_exact_quantiles(skewed):
    pdf, df = skewed
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.731, "e": 1.0}
    got = rank.exact_quantiles(df, ["g"], "v", probs, "n").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "n"] == len(part)
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(part["v"], p), abs=1e-9)


def test_exact_quantiles_of_everything_and_nulls(skewed):
    pdf, df = skewed
    df = df.withColumn("v", F.when(F.col("k") % 3 != 0, F.col("v")))
    want = np.quantile(pdf.loc[pdf.k % 3 != 0, "v"], [0.25, 0.9])
    assert rank.quantile_values(df, "v", [0.25, 0.9]) == pytest.approx(list(want))


def test_exact_quantiles_of_integers(spark):
    df = spark.range(10).select(F.lit("x").alias("g"), "id")
    row = rank.exact_quantiles(df, ["g"], "id", {"m": 0.5}).first()
    assert row["m"] == 4.5


def test_row_positions_are_a_permutation(skewed):
    pdf, df = skewed
    got = rank.row_positions(df, ["g"], ["v", "k"]).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values(["v", "k"])
        assert list(part["position"]) == list(range(1, len(part) + 1))
        assert set(part["position_total"]) == {len(part)}


def test_order_codes_small_and_distributed(spark, monkeypatch):
    names = spark.createDataFrame([("b",), ("a",), ("d",), ("c",)], "n string")
    want = {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.n: r.code for r in rank.order_codes(names, "n", "code").collect()} == want
    monkeypatch.setattr(rank, "BROADCAST_ROWS", 2)
    assert {r.n: r.code for r in rank.order_codes(names, "n", "code").collect()} == want


@pytest.fixture()
def many_cells(spark):
    """Keep every range partition, so groups really span several cells."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_groups_spanning_cells(skewed, many_cells):
    pdf, df = skewed
    laid = df.repartitionByRange("g", "v", "k").withColumn("p", F.spark_partition_id())
    assert laid.filter("g = 'hot'").select("p").distinct().count() > 1
    got = rank.ordered_prefix(df, ["g"], ["v", "k"], {"c": "k"}).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values(["v", "k"])
        assert list(part["c"]) == list(part["k"].cumsum()) and set(part["c_total"]) == {part["k"].sum()}
    q = rank.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.77}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert list(q.loc[g, ["a", "b"]]) == pytest.approx(list(np.quantile(part["v"], [0.1, 0.77])))
    assert rank.quantile_values(df, "v", [0.5]) == pytest.approx([pdf["v"].median()])
    at = rank.row_positions(df, [], ["v", "k"]).toPandas().sort_values(["v", "k"])["position"]
    assert list(at) == list(range(1, len(pdf) + 1))


def test_ks_matches_brute_force(skewed):
    pdf, df = skewed
    got = drift.ks_pairs(df, ["g"], "v", "split", [("train", "test")]).toPandas().set_index("g")["ks_train_test"]
    for g, part in pdf.groupby("g"):
        xs = np.sort(part["v"].unique())
        cdf = lambda s: np.searchsorted(np.sort(part.loc[part.split == s, "v"]), xs, side="right") / (part.split == s).sum()
        assert got[g] == pytest.approx(np.max(np.abs(cdf("train") - cdf("test"))))


def test_checked_broadcast_falls_back(spark):
    from weekloom.runtime import small_side

    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(50).withColumnRenamed("id", "k")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(big.join(small_side(small, 100), "k"))
    assert "broadcast" not in plan(big.join(small_side(small, 10), "k"))
    assert big.join(small_side(small, 10), "k").count() == 50
