"""Boundary rules on hand-made frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weekloom.functions import dates, numbers, text
from weekloom.operators import blend, evaluate, features, joins, seasonal, splits, tidy, weekly


def monday(k):
    return dt.date(2020, 12, 7) + dt.timedelta(days=7 * k)


@pytest.fixture()
def two(spark):
    rows = [("x", d, monday(i), i, 10 * (d == "B") + i) for d in ("A", "B") for i in range(6)]
    return spark.createDataFrame(rows, "disease string, district string, week_start date, week_index bigint, target bigint")


def test_rolling_never_crosses_a_district(two):
    df = features.target_rolling(two, [2])
    first = df.filter("week_index = 0").collect()
    assert all(r.target_roll_mean_2 is None and r.target_roll_max_2 is None for r in first)
    second = {r.district: r for r in df.filter("week_index = 1").collect()}
    assert second["B"].target_roll_mean_2 == 10 and second["A"].target_roll_mean_2 == 0
    assert second["B"].target_roll_std_2 is None  # one observation


def test_strict_rolling_waits_for_four(two):
    rows = {r.week_index: r.strict_mean_4 for r in features.strict_rolling(two).filter("district = 'A'").collect()}
    assert rows[3] is None and rows[4] == 1.5


def test_features_do_not_look_ahead(views):
    base = views.kept_panel.filter("district IN ('NATION_0', 'NATION_1')")
    cut = base.agg(F.max("week_index")).first()[0] * 3 // 4
    later = F.col("week_index") > cut
    changed = base.withColumn("target", F.when(later, F.col("target") + 50).otherwise(F.col("target")))
    changed = changed.withColumn("T2M_avg", F.when(later, F.lit(999.0)).otherwise(F.col("T2M_avg")))
    keep = ["disease", "district", "week_start"]
    names = [c for c in features.build_features(base).columns if c not in keep]
    a = features.build_features(base).filter(~later).select(*keep, *names)
    b = features.build_features(changed).filter(~later).select(*keep, *names)
    # Train statistics use train rows only, and the cut lies inside train.
    stats = {"dist_mean", "late_dist_mean", "district_week_mean", "excess_over_seasonal", "ratio_to_seasonal"}
    same = [c for c in names if c not in stats]
    assert a.select(*keep, *same).exceptAll(b.select(*keep, *same)).count() == 0


def test_one_exchange_for_all_windows(views):
    from weekloom.operators.rank import order_codes

    codes = order_codes(views.districts.distinct(), "district", "district_enc")
    df = features.build_features(views.kept_panel, codes=codes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(disease") == 1
    assert plan.count("+- Sort [disease") <= 2


def test_lag_weeks_needs_a_full_history(spark):
    rows = [("A", monday(i), float(i)) for i in (0, 1, 2, 3, 5)]
    df = spark.createDataFrame(rows, "district string, week_start date, x double")
    got = joins.lag_weeks(df, ["x"], 2, ["district"]).collect()
    assert [(r.week_start, r.x_lag_1, r.x_lag_2) for r in sorted(got)] == [(monday(2), 1.0, 0.0), (monday(3), 2.0, 1.0)]


def test_iso_week_53_and_march(spark):
    df = spark.createDataFrame([(dt.date(2020, 12, 28),), (dt.date(2021, 3, 1),)], "week_start date")
    a, b = sorted(weekly.seasonal_encoding(df).collect())
    assert a.week_number == 53 and a.sin_week == pytest.approx(math.sin(2 * math.pi / 52))
    assert a.monsoon_NE and not (b.monsoon_NE or b.monsoon_SW or b.monsoon_IM2)  # March is the base level


def test_fill_of_an_all_null_series(spark):
    rows = [("A", monday(0), None), ("A", monday(1), 3), ("A", monday(2), None), ("B", monday(0), None)]
    df = spark.createDataFrame(rows, "district string, week_start date, y bigint")
    got = {(r.district, r.week_start): r.y for r in features.forward_backward_fill(df, ["y"], ["district"]).collect()}
    assert [got["A", monday(i)] for i in range(3)] == [3, 3, 3] and got["B", monday(0)] == 0


def test_bias_guard_and_limits(spark):
    rows = [("x", "low", 9, 0.4), ("x", "high", 90, 1.0), ("x", "tiny", 0, 2.0)]
    df = spark.createDataFrame(rows, "disease string, district string, target bigint, p double")
    got = {r.district: r.factor for r in blend.district_bias(df).collect()}
    assert got == {"low": 1.0, "high": 4.0, "tiny": 0.3}


def test_interval_stays_ordered(spark):
    df = spark.createDataFrame([(5.0, 3.0, 1.0), (-2.0, -1.0, 0.5)], "lower double, median double, upper double")
    for r in blend.ordered_interval(df).collect():
        assert 0 <= r.lower <= r.median <= r.upper


def test_r2_of_constant_actuals_is_null(spark):
    df = spark.createDataFrame([("x", 2, 1.0), ("x", 2, 3.0)], "g string, target bigint, p double")
    assert evaluate.regression_metrics(df, ["g"]).first().r2 is None


def test_ranking_tie_takes_the_first_name(spark):
    df = spark.createDataFrame([("x", "b", 1.0, 1.0, 0.5), ("x", "a", 1.0, 2.0, 0.5)], "disease string, model string, mae double, rmse double, r2 double")
    r = evaluate.model_ranking(df).first()
    assert (r.best_mae, r.best_rmse, r.best_r2) == ("a", "b", "a")


def test_published_comparison_gives_the_published_winners(spark):
    # Published mean absolute errors per disease: ARIMA, ensemble, sequence model.
    rows = [("leptospirosis", 6.027, 5.344, 5.280), ("typhus", 1.208, 0.933, 1.073), ("hepatitis_a", 0.464, 0.340, 0.417), ("chickenpox", 6.138, 6.868, 5.964)]
    wide = spark.createDataFrame(rows, "disease string, arima_mae double, ensemble_mae double, lstm_mae double")
    gain = evaluate.mae_improvement(wide, "arima", ["ensemble", "lstm"]).first()
    assert gain.ensemble_gain_pct == pytest.approx(12.21, abs=0.05) and gain.lstm_gain_pct == pytest.approx(9.12, abs=0.05)


def test_splits_partition_the_rows(two):
    df = splits.temporal_split(two, ["disease"], ["week_start", "district"])
    rows = sorted(df.collect(), key=lambda r: (r.week_start, r.district))
    assert [r.split for r in rows] == ["train"] * 9 + ["test", "val", "test"]
    for made in (splits.random_split(two, ["district", "week_start"]), splits.stratified_split(two, ["disease"], ["district", "week_start"])):
        assert made.count() == 12 and made.filter("split IS NULL").count() == 0
    strat = splits.stratified_split(two, ["disease"], ["district", "week_start"]).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in strat} == {"train": 9, "val": 1, "test": 2}


def test_seasonal_round_trip(views):
    df = seasonal.add_back(seasonal.seasonal_normalise(views.kept_series))
    assert df.filter("abs(restored - target) > 1e-6").count() == 0


def test_weights_have_mean_one(views):
    from weekloom.operators import drift

    s = views.kept_series
    for made in (drift.hist_reweight(s), drift.inverse_root_weights(s), drift.blend_weights_20_80(s), drift.align_weights(s), drift.zero_align_weights(s)):
        rows = made.groupBy("disease").agg(F.avg("weight").alias("mean"), F.count_if(F.col("weight").isNull()).alias("none")).collect()
        assert len(rows) == 4 and all(r.mean == pytest.approx(1.0, abs=1e-6) and r.none == 0 for r in rows)
        assert set(made.columns) == {*s.columns, "weight"} and made.select("split").distinct().count() == 1


def test_weights_of_small_and_odd_groups(spark):
    from weekloom.operators import drift

    rows = [("a", "train", x) for x in (0.0, 0.0, 1.0, 9.0, None)] + [("a", "val", 0.0), ("a", "val", 5.0), ("a", "test", 1.0), ("b", "train", 3.0), ("c", "val", 2.0)]
    df = spark.createDataFrame(rows, "disease string, split string, target double")
    for make in (drift.inverse_root_weights, drift.blend_weights_20_80, drift.align_weights, drift.zero_align_weights, drift.hist_reweight):
        assert make(df.limit(0)).count() == 0
        for r in make(df).collect():
            assert r.weight is None or r.weight >= 0
    got = {r.target: r.weight for r in drift.inverse_root_weights(df.filter("disease = 'a'")).collect()}
    assert got[None] is None and got[0.0] < got[1.0] == got[9.0]
    z = {(r.disease, r.target): r.standing_z for r in drift.standardise(df.withColumnRenamed("target", "standing").withColumn("target", F.col("standing")), ["standing"]).collect()}
    assert z["b", 3.0] == 0.0 and z["c", 2.0] is None and z["a", 0.0] < 0 < z["a", 9.0]


def test_text_and_numbers(spark):
    df = spark.createDataFrame([(" True ", 2.5, "Hepatitis A"), ("no", 3.5, "Typhus")], "f string, x double, n string")
    a, b = df.select(text.bool_from_text("f"), text.value_with_rounded("x"), text.slug("n")).collect()
    assert tuple(a) == (True, "2.50 (2)", "hepatitis_a") and tuple(b) == (None, "3.50 (4)", "typhus")
    one = spark.range(1).select(numbers.clip(F.lit(None).cast("double"), 0.0), numbers.capped_low(F.lit(2.0), F.lit(6.0)),
                                dates.epoch_date(F.lit(86399)), dates.epoch_date(F.lit(-1))).first()
    assert tuple(one) == (None, 4.0, dt.date(1970, 1, 1), dt.date(1969, 12, 31))


def test_clean_district(spark):
    df = spark.createDataFrame([(" NuwaraEliya",), ("Kalmune ",), ("Galle",)], "district string")
    assert sorted(r[0] for r in tidy.clean_district(df).collect()) == ["Galle", "Nuwara Eliya"]


def test_require_finite(spark):
    ok = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert tidy.require_finite(ok, ["x"]).count() == 2
    bad = spark.createDataFrame([(float("inf"),)], "x double")
    with pytest.raises(Exception, match="NaN or infinite"):
        tidy.require_finite(bad, ["x"]).collect()
