"""Panel views over the generic order / line item / event tables.

Nations play the districts, order priorities the diseases, line items the daily
climate and events the sub-daily readings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from weekloom.constants import DISEASES, MODEL_FEATURES
from weekloom.operators import ensemble, features, learn, weekly
from weekloom.operators.rank import order_codes
from weekloom.runtime import shared_root, small_side, stored
from weekloom.sources.models import ModelStore

MODEL_KEYS = ["disease", "district", "week_start"]

PRIORITY_DISEASE = {
    "1-URGENT": "leptospirosis", "2-HIGH": "typhus", "3-MEDIUM": "hepatitis_a", "5-LOW": "chickenpox",
}


class PanelViews:
    """Lazy views for one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def districts(self) -> DataFrame:
        return self.table("nation").select(F.col("n_name").alias("district"))

    @cached_property
    def order_district(self) -> DataFrame:
        """orders with the district of their customer."""
        home = self.table("customer").join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
        return self.table("orders").join(home, F.expr("o_custkey = c_custkey"))

    @cached_property
    def cases_daily(self) -> DataFrame:
        disease = F.lit(None).cast("string")
        for priority, name in PRIORITY_DISEASE.items():
            disease = F.when(F.col("o_orderpriority") == priority, name).otherwise(disease)
        return self.order_district.filter(F.col("o_orderpriority").isin(*PRIORITY_DISEASE)).select(
            F.col("n_name").alias("district"), F.col("o_orderdate").cast("date").alias("d"), disease.alias("disease")
        )

    @cached_property
    def cases_weekly(self) -> DataFrame:
        return weekly.count_weekly(self.cases_daily)

    @cached_property
    def climate_daily(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.order_district, F.expr("l_orderkey = o_orderkey"))
            .groupBy(F.col("n_name").alias("district"), F.col("l_shipdate").cast("date").alias("d"))
            .agg(
                F.avg("l_quantity").alias("T2M"),
                F.max("l_quantity").alias("T2M_MAX"),
                F.min("l_quantity").alias("T2M_MIN"),
                (F.avg("l_discount") * 1000).alias("RH2M"),
                (F.avg("l_extendedprice") / 9973).alias("PRECTOTCORR"),
            )
        )

    @cached_property
    def climate_weekly(self) -> DataFrame:
        return weekly.weekly_climate(self.climate_daily)

    @cached_property
    def calendar(self) -> DataFrame:
        return weekly.week_calendar(self.districts, self.table("orders"), "o_orderdate")

    @cached_property
    def panel_cases(self) -> DataFrame:
        """Dense calendar with nullable case counts, no climate."""
        key = ["district", "week_start"]
        return self.calendar.join(weekly.count_weekly_wide(self.cases_daily), key, "left").withColumn(
            "week_index", F.floor(F.datediff("week_start", "first_week") / 7)
        ).drop("first_week")

    @cached_property
    def panel_wide(self) -> DataFrame:
        """Dense calendar LEFT JOIN weekly climate LEFT JOIN weekly counts; gaps stay NULL."""
        return self.panel_cases.join(self.climate_weekly, ["district", "week_start"], "left")

    @cached_property
    def series(self) -> DataFrame:
        """Long dense case series: disease, district, week_start, week_index, week_number, target, split."""
        long = weekly.melt_diseases(self.panel_cases, ["district", "week_start", "week_index"])
        return self._finish(long)

    @cached_property
    def panel(self) -> DataFrame:
        """Long dense panel with climate and season columns."""
        wide = weekly.seasonal_encoding(self.panel_wide)
        ids = [c for c in wide.columns if c not in DISEASES]
        return self._finish(weekly.melt_diseases(wide, ids))

    def _finish(self, long: DataFrame) -> DataFrame:
        """Zero-filled target, ISO week and the temporal split by week (80 % train, then alternating)."""
        weeks = self.table("orders").agg(
            (F.floor(F.datediff(F.max(weekly.week_start("o_orderdate")), F.min(weekly.week_start("o_orderdate"))) / 7) + 1)
        ).scalar()
        cut = F.floor(weeks * 4 / 5)
        index = F.col("week_index")
        split = F.when(index < cut, "train").when((index - cut) % 2 == 1, "val").otherwise("test")
        return long.withColumns(
            {
                "target": F.coalesce("target", F.lit(0).cast("bigint")),
                "week_number": F.weekofyear("week_start"),
                "split": split,
            }
        )

    @cached_property
    def codes(self) -> DataFrame:
        return small_side(order_codes(self.districts.distinct(), "district", "district_enc"))

    @cached_property
    def features(self) -> DataFrame:
        return features.build_features(self.panel, codes=self.codes)

    @cached_property
    def forecasts(self) -> DataFrame:
        """Two simple forecasts of each row: ``a`` recent level, ``b`` seasonal train mean."""
        df = features.train_statistics(self.series)
        recent = features.series_window().rowsBetween(-4, -1)
        df = df.withColumn("a", F.coalesce(F.avg("target").over(recent), F.lit(0.0)))
        return df.select(
            "disease", "district", "week_start", "week_index", "week_number", "split", "target", "a",
            F.col("district_week_mean").alias("b"),
        )

    @cached_property
    def kept_series(self) -> DataFrame:
        """``series`` written once, for operators that make several passes."""
        return stored(self.series, "series")

    @cached_property
    def kept_panel(self) -> DataFrame:
        return stored(self.panel, "panel")

    @cached_property
    def kept_features(self) -> DataFrame:
        return stored(self.features, "features")

    @cached_property
    def kept_forecasts(self) -> DataFrame:
        return stored(self.forecasts, "forecasts")

    @cached_property
    def model_table(self) -> DataFrame:
        """All model features as one vector, written once beside the models."""
        return self._beside("table", lambda: learn.assemble(self.features, MODEL_FEATURES, [*MODEL_KEYS, "split", "target"]))

    def _beside(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.store.path}/{name}"
        try:  # a table without committed files has no schema and is written again
            return self.spark.read.parquet(path)
        except AnalysisException:
            make().write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)

    @cached_property
    def store(self) -> ModelStore:
        """The application's model store of this folder: what one query has fitted, later ones load.

        It holds for the folder as it was when the application first used it.
        """
        name = hashlib.sha1(f"{self.spark.sparkContext.applicationId}|{self.folder}".encode()).hexdigest()[:16]
        return ModelStore(self.spark, f"{shared_root(self.spark)}/store-{name}")

    def learned(self, *parts: str) -> ModelStore:
        """The store with these learners of every disease in it; the table is only read if one is missing."""
        have = self.store.listed()
        if any((d, p) not in have for d in ensemble.SETTINGS for p in parts):
            ensemble.fit_all(self.model_table, MODEL_FEATURES, self.store, parts)
        return self.store

    @cached_property
    def blended(self) -> DataFrame:
        """Held-out rows of the ensemble: both learners, their intervals, blend, area bias."""
        keep = [*MODEL_KEYS, "split", "target"]
        store = self.learned(*ensemble.LEARNERS)
        return ensemble.blended(self._beside("intervals", lambda: ensemble.learner_intervals(self.model_table, store, MODEL_KEYS, keep)))

    @cached_property
    def readings(self) -> DataFrame:
        """Sub-daily readings per district, one row per event."""
        return readings_of(self.table("events"))


def readings_of(events: DataFrame) -> DataFrame:
    v = F.col("value") / 7.31
    return events.select(
        "event_id", "ts", F.concat(F.lit("D"), (F.col("user_id") % 25).cast("string")).alias("district"),
        "event_type", v.alias("T2M"), (v + 1).alias("T2M_MAX"), (v - 1).alias("T2M_MIN"),
        (v * 3 % 101).alias("RH2M"), (v / 3).alias("PRECTOTCORR"),
    )
