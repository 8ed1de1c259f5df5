"""Exact order statistics and running sums that never put one group into one task.

``ordered_prefix`` range-partitions rows by (group, order), keeps that layout in a
reliable checkpoint, sums every (group, partition) cell and offsets the cells. A
task then only handles one cell, however large its group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.runtime import BROADCAST_ROWS, durable

CELL = "_cell"


def ordered_prefix(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums ``{out: column}`` per group in ``order``, plus ``{out}_total``."""
    by = list(by)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = durable(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(CELL, F.spark_partition_id()))
    key = [*by, CELL]
    cells = laid.groupBy(*key).agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    if not by:
        # One group: the cells are at most one row per partition, so a single task is bounded.
        cells = cells.withColumn("_all", F.lit(0))
        before = Window.partitionBy("_all").orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("_all")
    offsets = cells.select(
        *key,
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_s_{o}").over(whole).alias(f"{o}_total") for o in sums],
    )
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.join(offsets, key)
        .withColumns({o: F.sum(c).over(inside) + F.col(f"_o_{o}") for o, c in sums.items()})
        .drop(CELL, *[f"_o_{o}" for o in sums])
    )


def row_positions(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "position"
) -> DataFrame:
    """1-based position of each row in its group's order, and ``{out}_total``."""
    return ordered_prefix(df.withColumn("_one", F.lit(1).cast("bigint")), by, order, {out: "_one"}).drop("_one")


def order_codes(names: DataFrame, column: str, out: str) -> DataFrame:
    """0-based alphabetical position of distinct names.

    The names are kept once and counted: up to ``BROADCAST_ROWS`` of them are numbered in
    one sort, more of them by the distributed positions.
    """
    names = durable(names)
    if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1
        return names.select(column, place.cast("bigint").alias(out))
    return row_positions(names, [], [column], out).select(column, (F.col(out) - 1).alias(out))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], size: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles ``{out: p}`` per group; NULL values are skipped.

    Equal values are counted before the shuffle, so a value held by a third of the
    rows is one row afterwards. At most two rows per quantile and group survive the
    rank filter and meet in the last aggregate. ``size`` names an optional count column.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = ordered_prefix(counts, by, [value], {"_c": "_n"})
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs.values()]), lambda p: p * (F.col("_c_total") - 1))
    run = run.withColumn("_at", at).withColumn("_from", F.col("_c") - F.col("_n"))
    near = lambda r: (F.ceil(r) >= F.col("_from")) & (F.floor(r) < F.col("_c"))
    picked = (
        run.filter(F.exists("_at", near))
        .groupBy(*by)
        .agg(
            F.max("_c_total").alias("_n"), F.first("_at").alias("_at"),
            F.collect_list(F.struct(F.col("_from").alias("lo"), F.col("_c").alias("hi"), F.col(value).cast("double").alias("v"))).alias("_vs"),
        )
    )
    pick = lambda r: F.get(F.filter("_vs", lambda x: (x.getField("lo") <= r) & (r < x.getField("hi"))), F.lit(0)).getField("v")
    between = lambda r: pick(F.floor(r)) + (pick(F.ceil(r)) - pick(F.floor(r))) * (r - F.floor(r))
    out = picked.withColumn("_q", F.transform("_at", between))
    cols = [F.col("_q")[i].alias(o) for i, o in enumerate(probs)]
    return out.select(*by, *cols, *([F.col("_n").alias(size)] if size else []))


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Whole-table quantiles as plain numbers: one row reaches the driver."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = exact_quantiles(df, [], value, names).first()
    return [float(row[n]) for n in names]
