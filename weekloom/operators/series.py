"""Keyed time-series operators over (key, order, value) tables.

The country totals of the weekly panel are one key among many; every operator runs
all keys at once. A key's series has one row per calendar step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.numbers import ratio
from weekloom.runtime import durable


def _ordered(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def acf(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int = 20) -> DataFrame:
    """Autocorrelation to ``lags``: mean-centred, denominator n * var."""
    w = _ordered(by, order)
    rows = df.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    rows = rows.withColumns({f"_l{k}": F.lag("_x", k).over(w) for k in range(1, lags + 1)})
    bottom = F.sum(F.col("_x") * F.col("_x"))
    cells = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))] + [
        F.struct(F.lit(k).alias("lag"), ratio(F.sum(F.col("_x") * F.col(f"_l{k}")), bottom).alias("acf")) for k in range(1, lags + 1)]
    return rows.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.inline("cells"))


def pacf(acf_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Partial autocorrelation from acf rows (at most lags + 1 per key) by the Durbin recursion."""
    import pandas as pd

    by = list(by)
    schema = ", ".join(f"{n} {t}" for n, t in acf_rows.dtypes if n in by) + ", lag int, pacf double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy()
        phi, out, noise = [], [1.0], 1.0
        for k in range(1, len(r)):
            last = (r[k] - sum(p * r[k - 1 - i] for i, p in enumerate(phi))) / noise
            phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
            noise *= 1.0 - last * last
            out.append(last)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(r) for c in by}, "lag": range(len(r)), "pacf": out})

    return acf_rows.groupBy(*by).applyInPandas(fold, schema)


def unit_root_screen(df: DataFrame, by: Sequence[str], order: str, value: str, critical: float = -2.86) -> DataFrame:
    """Dickey-Fuller without lags: t statistic of the level in a regression of the change on it."""
    x = F.lag(value, 1).over(_ordered(by, order)).cast("double")
    rows = df.withColumn("_x", x).withColumn("_y", F.col(value) - F.col("_x"))
    s = rows.groupBy(*by).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"), F.regr_count("_y", "_x").alias("n"))
    rss = F.col("_syy") - F.col("_sxy") ** 2 / F.col("_sxx")
    t = F.col("slope") / F.sqrt(rss / (F.col("n") - 2) / F.col("_sxx"))
    return s.withColumn("t_stat", t).withColumn("stationary", F.col("t_stat") < critical).drop("_sxx", "_syy", "_sxy")


def seasonal_decompose(df: DataFrame, by: Sequence[str], order: str, value: str, period: int = 26) -> DataFrame:
    """Additive: centred moving average of two half-weighted ends, mean of each season position, rest."""
    h = period // 2
    w = _ordered(by, order)
    full = w.rowsBetween(-h, h)
    ends = F.lag(value, h).over(w) + F.lead(value, h).over(w)
    trend = F.when(F.count(value).over(full) == 2 * h + 1, (F.sum(value).over(full) - ends / 2) / period)
    rows = df.withColumns({"trend": trend, "_pos": (F.row_number().over(w) - 1) % period})
    rows = rows.withColumn("_d", F.col(value) - F.col("trend"))
    rows = rows.withColumn("_p", F.avg("_d").over(Window.partitionBy(*by, "_pos")))
    # The centre of the pattern is the mean over its positions, each counted once.
    once = F.when(F.row_number().over(w) <= period, F.col("_p"))
    rows = rows.withColumn("seasonal", F.col("_p") - F.avg(once).over(Window.partitionBy(*by)))
    return rows.withColumn("residual", F.col("_d") - F.col("seasonal")).drop("_pos", "_d", "_p")


def ema(df: DataFrame, by: Sequence[str], order: str, value: str, alpha: float = 0.12) -> DataFrame:
    """Exponential moving average, started at the first value and anew after a NULL; NULL where the value is.

    A step is the affine map e -> (1 - alpha) e + alpha v, and maps compose to maps. Rows are laid
    out in range cells of (key, order); each cell's maps compose to one pair per key, the
    few pairs of a key are folded in order to the average that enters a cell, and a second
    pass runs through each cell from there. Both passes are linear and no task holds a series.
    """
    import pandas as pd

    by = list(by)
    laid = durable(df.select(*by, order, F.col(value).cast("double").alias("_v")).repartitionByRange(*by, F.col(order)).withColumn("_cell", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_cell").orderBy(order)
    keep = 1.0 - alpha
    # Rows since the last start: after a NULL, and at the key's first row, the average starts anew.
    numbered = laid.withColumns({"_k": F.row_number().over(inside), "_run": F.sum(F.when(F.col("_v").isNull(), 1).otherwise(0)).over(inside)})
    key = [*by, "_cell"]
    ends = numbered.groupBy(*key).agg(
        F.max("_run").alias("_nulls"), F.count("*").alias("_n"), F.max_by("_v", "_k").alias("_end"))
    last = numbered.join(ends, key).filter("_run = _nulls AND _v IS NOT NULL").groupBy(*key).agg(
        # the open run of a cell: its values weighted by the steps that follow, and by the start's full weight
        F.sum(F.col("_v") * alpha * F.pow(F.lit(keep), F.col("_n") - F.col("_k"))).alias("_b"),
        F.count("*").alias("_m"), F.min_by("_v", "_k").alias("_first"))
    cells = ends.join(last, key, "left")
    pair = F.struct(
        F.col("_cell").alias("cell"), (F.col("_nulls") > 0).alias("cut"), F.col("_m").alias("m"),
        F.coalesce("_b", F.lit(0.0)).alias("b"), F.col("_first").alias("first"))
    folded = cells.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("cells"))  # a key's cells

    def through(enters, c):
        """Average that leaves a cell: a run that starts in it takes its first value in full."""
        started = c.getField("b") + c.getField("first") * keep * F.pow(F.lit(keep), c.getField("m") - 1)
        carried = enters * F.pow(F.lit(keep), c.getField("m")) + c.getField("b")
        return F.when(c.getField("m").isNull(), F.lit(None).cast("double")).when(c.getField("cut") | enters.isNull(), started).otherwise(carried)

    enters = F.transform("cells", lambda c, i: F.struct(c.getField("cell").alias("_cell"), F.aggregate(
        F.slice(F.col("cells"), F.lit(1), i), F.lit(None).cast("double"), through).alias("_enters")))
    start = folded.select(*by, F.inline(enters))
    rows = laid.join(start, key).repartition("_cell", *by).sortWithinPartitions("_cell", *by, order)
    names = [*by, order, "_v", "_enters", "_cell"]

    def run(batches):
        held, level = None, None
        for b in batches:
            if not len(b):
                continue
            same = (b[[*by, "_cell"]].astype(str) == b[[*by, "_cell"]].astype(str).shift()).all(axis=1)
            group = (~same).cumsum()
            out = []
            for _, g in b.groupby(group, sort=False):
                now = tuple(g[[*by, "_cell"]].astype(str).iloc[0])
                if now != held:
                    held, level = now, g["_enters"].iloc[0]
                null = g["_v"].isna()
                parts = []
                for _, r in g.groupby(null.cumsum(), sort=False):
                    v = r["_v"]
                    if pd.isna(v.iloc[0]):  # the run behind a NULL
                        level, v = None, v.iloc[1:]
                        parts.append(pd.Series([float("nan")], index=r.index[:1]))
                    if len(v):
                        series = v if level is None or pd.isna(level) else pd.concat([pd.Series([level]), v])
                        e = series.ewm(alpha=alpha, adjust=False).mean().iloc[len(series) - len(v):]
                        level = e.iloc[-1]
                        parts.append(e)
                out.append(pd.concat(parts))
            yield b.assign(ema=pd.concat(out))[[*by, order, "_v", "ema"]]

    types = dict(df.dtypes)
    shape = ", ".join(f"`{c}` {types[c]}" for c in [*by, order]) + ", _v double, ema double"
    done = rows.select(*names).mapInPandas(run, shape)
    return done.select(*by, order, F.col("_v").alias(value), F.when(~F.isnan("ema"), F.col("ema")).alias("ema"))


def curve_normalise(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Each round's value over the first round's."""
    return df.withColumn("normalised", ratio(F.col(value), F.first(value).over(_ordered(by, order))))


def curve_best_round(df: DataFrame, by: Sequence[str], order: str, value: str, low: int, high: int) -> DataFrame:
    """Round of the smallest value (the earliest on a tie), kept inside [low, high]."""
    best = F.min(F.struct(F.col(value), F.col(order).alias("o")))
    capped = F.least(F.greatest(best.getField("o"), F.lit(low)), F.lit(high))
    return df.groupBy(*by).agg(best.getField("o").alias("best"), capped.alias("best_capped"), F.min(value).alias("lowest"))


def curve_smooth_flag(df: DataFrame, by: Sequence[str], order: str, value: str, limit: float = 0.01) -> DataFrame:
    """Largest rise after the minimum and whether it stays within ``limit``."""
    whole = Window.partitionBy(*by)
    rows = df.withColumn("_b", F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("o"))).over(whole))
    rise = F.max(F.when(F.col(order) >= F.col("_b.o"), F.col(value) - F.col("_b.v")))
    return rows.groupBy(*by).agg(rise.alias("rise")).withColumn("smooth", F.col("rise") <= limit)


def curve_truncate(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Rounds up to the minimum of the mean of several curves."""
    mean = sum((F.col(c) for c in values), F.lit(0.0)) / len(values)
    rows = df.withColumn("mean_curve", mean)
    best = F.min(F.struct(F.col("mean_curve").alias("v"), F.col(order).alias("o"))).over(Window.partitionBy(*by))
    return rows.withColumn("_b", best).filter(F.col(order) <= F.col("_b.o")).drop("_b")
