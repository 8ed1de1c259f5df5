"""Connected components of a link table: distributed union-find by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.runtime import durable


def _star(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) of every id in ``links``; root is the smallest id reachable.

    Every round hangs a node's neighbours on its smallest one. Minima are
    aggregated before the shuffle and joined back one row per node, so a hub can
    be split; the tables of a round are checkpointed.
    """
    e = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _star(both).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = _star(large).withColumnRenamed("u", "c")
        small = large.join(lowest, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.union(lowest.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
