"""Weekly cache, exports and reference dimensions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from weekloom.constants import DAILY_SOURCE_COORDINATES, READING_SOURCE_COORDINATES


def write_weeks(df: DataFrame, path: str, week: str = "week_start") -> None:
    """Replace exactly the weeks present in ``df``; writing them again changes nothing."""
    (
        df.hint("rebalance", week)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(week)
        .parquet(path)
    )


class WeekCache:
    """Computed weeks in a partitioned folder, with a manifest of the weeks that were computed.

    Weeks are computed when they are missing from the manifest, and only those: a request
    that is in the cache as a whole does not touch the raw rows. A week without rows is in
    the manifest as well. Weeks are written before they are listed, so a run that was
    lost between the two computes them again and replaces the same folders.
    """

    def __init__(self, spark: SparkSession, path: str, week: str = "week_start"):
        self.spark, self.data, self.manifest, self.week = spark, f"{path}/data", f"{path}/weeks", week

    def _read(self, path: str) -> DataFrame | None:
        try:  # an empty or absent folder has no schema
            return self.spark.read.parquet(path)
        except AnalysisException:
            return None

    def missing(self, wanted: DataFrame) -> list[date]:
        """Wanted weeks that are not listed: at most one value per wanted week, and a panel has few."""
        weeks, listed = wanted.select(self.week).distinct(), self._read(self.manifest)
        if listed is not None:
            weeks = weeks.join(listed, self.week, "left_anti")
        return sorted(r[0] for r in weeks.collect())

    def fill(self, wanted: DataFrame, compute: Callable[[list[date]], DataFrame]) -> list[date]:
        """Compute and store the missing weeks; returns them. Other weeks of the computed rows are not stored."""
        weeks = self.missing(wanted)
        if weeks:
            write_weeks(compute(weeks).filter(F.col(self.week).isin(weeks)), self.data, self.week)
            self.spark.createDataFrame([(w,) for w in weeks], f"{self.week} date").coalesce(1).write.mode("append").parquet(self.manifest)
        return weeks

    def read(self, wanted: DataFrame, compute: Callable[[list[date]], DataFrame]) -> DataFrame:
        """Rows of the wanted weeks from the cache, filled before; ``source`` tells which were computed just now."""
        new = self.fill(wanted, compute)
        cached = self._read(self.data)
        if cached is None:  # all weeks so far are without rows
            return compute([]).filter("false").withColumn("source", F.lit(None).cast("string"))
        cached = cached.withColumn(self.week, F.col(self.week).cast("date"))
        return cached.join(wanted.select(self.week).distinct(), self.week, "left_semi").withColumn(
            "source", F.when(F.col(self.week).isin(new), "computed").otherwise("cache"))


def write_split_tables(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per disease and split; rebalancing gives each folder few files and splits large ones."""
    keys = ["disease", "split"]
    writer = df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls) for every column from one pass."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.sum(F.col(f"`{c}`").isNull().cast("bigint")).alias("nulls")) for c in df.columns
    ])
    return df.agg(F.count("*").alias("rows"), cells.alias("cells")).select("rows", F.inline("cells"))


def district_dimension(spark: SparkSession) -> DataFrame:
    """Both coordinate lists, the source being part of the key because they disagree."""
    rows = [
        (source, name, float(lat), float(lon))
        for source, places in (("daily", DAILY_SOURCE_COORDINATES), ("readings", READING_SOURCE_COORDINATES))
        for name, (lat, lon) in places.items()
    ]
    return spark.createDataFrame(rows, "source string, district string, lat double, lon double")


