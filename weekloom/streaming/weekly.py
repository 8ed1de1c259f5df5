"""Readings arriving as files, rolled up to Monday weeks that late files can still change.

Every micro-batch is reduced to mergeable parts (largest, smallest, sum, count) per area
and week and written to a folder of its own; a retried batch overwrites its folder, so
it cannot count twice. Reading merges the parts, whatever the order in which they came:
no row is dropped for being late, and no state has to be kept open for it. Rows behind
the watermark are reported next to the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.constants import CLIMATE_VARIABLES
from weekloom.functions.dates import epoch_date, utc_instant

LATE = "7 days"


def _week_of(ts: str) -> Column:
    """Monday of an instant, by its epoch day (day 0 is a Thursday), whatever the session time zone."""
    day = F.floor(F.unix_seconds(ts) / 86400)
    return epoch_date((day - F.pmod(day + 3, F.lit(7))) * 86400)


def weekly_parts(readings: DataFrame, ts: str = "ts", area: str = "district", variables: Sequence[str] = CLIMATE_VARIABLES) -> DataFrame:
    """Parts of the weekly statistics per area and week, with the rows and the newest instant behind them.

    Rows without an instant or area are left out, as they belong to no week.
    """
    if dict(readings.dtypes)[ts] == "timestamp_ntz":
        readings = readings.withColumn(ts, utc_instant(ts))
    cells = [f(v).alias(f"{v}_{n}") for v in variables for n, f in (("max", F.max), ("min", F.min), ("sum", F.sum), ("count", F.count))]
    return readings.filter(F.col(ts).isNotNull() & F.col(area).isNotNull()).groupBy(area, _week_of(ts).alias("week_start")).agg(
        *cells, F.count("*").alias("rows"), F.max(ts).alias("newest"))


def run_to_table(readings: DataFrame, path: str, state: str, ts: str = "ts", area: str = "district") -> None:
    """Drain the available input of a readings stream into parts below ``path``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        weekly_parts(batch, ts, area).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = readings.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()


def _merged(parts: DataFrame, keys: Sequence[str], variables: Sequence[str], average: bool) -> DataFrame:
    cells = []
    for v in variables:
        total, n = F.sum(f"{v}_sum"), F.sum(f"{v}_count")
        cells += [F.max(f"{v}_max").alias(f"{v}_max"), F.min(f"{v}_min").alias(f"{v}_min")]
        cells += [(total / F.nullif(n, F.lit(0))).alias(f"{v}_avg")] if average else [total.alias(f"{v}_sum"), n.alias(f"{v}_count")]
    return parts.groupBy(*keys).agg(*cells, *([] if average else [F.sum("rows").alias("rows"), F.max("newest").alias("newest")]))


def read_table(spark: SparkSession, path: str, area: str = "district", variables: Sequence[str] = CLIMATE_VARIABLES) -> DataFrame:
    """Largest, smallest and mean value of every variable per area and week over all batches so far."""
    return _merged(spark.read.parquet(path), [area, "week_start"], variables, True)


def late_rows(spark: SparkSession, path: str, late: str = LATE) -> DataFrame:
    """(batch, rows, late): rows of each batch, and those of weeks that the watermark had closed.

    The watermark of a batch is the newest instant of the batches before it minus ``late``. Such
    rows are part of the result; a consumer that has published a closed week sees here that it changed.
    """
    parts = spark.read.parquet(path)
    newest = parts.groupBy("batch").agg(F.max("newest").alias("newest"))  # one row per batch
    mark = newest.select("batch", (F.max("newest").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)) - F.expr(f"INTERVAL {late}")).alias("mark"))
    closed = F.unix_seconds("mark") >= (F.unix_date("week_start") + 7) * 86400
    return parts.join(mark, "batch").groupBy("batch").agg(F.sum("rows").alias("rows"), F.sum(F.when(closed, F.col("rows")).otherwise(0)).alias("late"))


def compact(spark: SparkSession, path: str, target: str, area: str = "district", variables: Sequence[str] = CLIMATE_VARIABLES) -> None:
    """Merge all batches into one below ``target``, under the number of the newest; its late report starts anew."""
    parts = spark.read.parquet(path)
    last = parts.agg(F.max("batch")).first()[0]
    if last is not None:
        _merged(parts, [area, "week_start"], variables, False).write.mode("overwrite").parquet(f"{target}/batch={last}")
