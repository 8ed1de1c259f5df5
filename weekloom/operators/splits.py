"""Train / validation / test assignment. ``split`` is set once and never re-derived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.rank import row_positions


def temporal_split(df: DataFrame, by: Sequence[str], order: Sequence[str], train: float = 0.8) -> DataFrame:
    """First share of the rows in ``order`` is train, the rest alternates test, val, test, ...

    ``order`` must identify a row inside its group (week, then district).
    """
    rows = row_positions(df, by, order, "position")
    cut = F.floor(F.col("position_total") * train)
    rest = F.col("position") - 1 - cut
    split = F.when(rest < 0, "train").when(rest % 2 == 1, "val").otherwise("test")
    return rows.withColumn("split", split).drop("position_total")


def tail_split(df: DataFrame, by: Sequence[str], order: Sequence[str], train: float = 0.8) -> DataFrame:
    """First share train, the tail val."""
    rows = row_positions(df, by, order, "position")
    inside = F.col("position") <= F.floor(F.col("position_total") * train)
    return rows.withColumn("split", F.when(inside, "train").otherwise("val")).drop("position_total")


def hash_bucket(keys: Sequence[str], seed: int, buckets: int = 1000):
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(buckets))


def random_split(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """80/10/10 by the hash of the row key: no shuffle, the same on every run."""
    h = hash_bucket(keys, seed)
    return df.withColumn("split", F.when(h < 800, "train").when(h < 900, "val").otherwise("test"))


def stratified_split(df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exact 80/10/10 inside each stratum, rows taken in hash order.

    A stratum (the zeros of a disease) may hold most rows, so its order comes from
    ``row_positions`` and not from one window.
    """
    df = df.withColumn("_h", F.xxhash64(*keys, F.lit(seed)))
    rows = row_positions(df, strata, ["_h", *keys], "position")
    n, k = F.col("position_total"), F.col("position")
    split = F.when(k <= F.floor(n * 0.8), "train").when(k <= F.floor(n * 0.9), "val").otherwise("test")
    return rows.withColumn("split", split).drop("_h", "position", "position_total")


def split_by_week_range(df: DataFrame, bounds: DataFrame, week: str = "week_index") -> DataFrame:
    """Re-cut by the week ranges of given splits. The ranges overlap for random splits, so a row
    may come back under several splits: kept as a screen, not for fitting."""
    of = lambda s: F.when(F.col("split") == s, F.col(week))
    b = bounds.agg(F.struct(
        F.max(of("train")).alias("a"), F.min(of("val")).alias("b"), F.max(of("val")).alias("c"), F.min(of("test")).alias("d"))).scalar()
    x = F.col(week)
    hits = F.array_compact(F.array(
        F.when(x <= b.getField("a"), F.lit("train")),
        F.when((x >= b.getField("b")) & (x <= b.getField("c")), F.lit("val")),
        F.when(x >= b.getField("d"), F.lit("test"))))
    return df.withColumn("split", F.explode(hits))
