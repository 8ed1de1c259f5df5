"""Distribution shift, leakage screens and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.numbers import clip, ratio
from weekloom.operators.profile import bin_index, melt
from weekloom.operators.rank import exact_quantiles, ordered_prefix, quantile_values


def shift_report(df: DataFrame, by: Sequence[str] = ("disease",), value: str = "target", severe: float = 0.3) -> DataFrame:
    """Mean and deviation per split with the relative shift of val and test against train."""
    pick = lambda s: F.when(F.col("split") == s, F.col(value))
    stats = [f(pick(s)).alias(f"{n}_{s}") for s in ("train", "val", "test") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    out = df.groupBy(*by).agg(*stats)
    shift = {f"shift_{s}": ratio(F.abs(F.col(f"mean_{s}") - F.col("mean_train")), F.abs("mean_train")) for s in ("val", "test")}
    return out.withColumns(shift).withColumn("severe", F.greatest("shift_val", "shift_test") > severe)


def ks_pairs(df: DataFrame, by: Sequence[str], value: str, sample: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Largest gap between two empirical distribution functions, for several sample pairs at once.

    Values are counted per sample before the shuffle; the running counts come from
    ``ordered_prefix``, so a feature with very many distinct values is spread over tasks.
    """
    names = sorted({s for p in pairs for s in p})
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[F.count_if(F.col(sample) == s).alias(f"_n_{s}") for s in names])
    run = ordered_prefix(counts, by, [value], {f"_c_{s}": f"_n_{s}" for s in names})
    ecdf = {s: ratio(F.col(f"_c_{s}"), F.col(f"_c_{s}_total")) for s in names}
    return run.groupBy(*by).agg(*[F.max(F.abs(ecdf[a] - ecdf[b])).alias(f"ks_{a}_{b}") for a, b in pairs])


def leakage_screen(df: DataFrame, features: Sequence[str], low: float = 0.2, high: float = 0.1, by: Sequence[str] = ("disease",)) -> DataFrame:
    """KS of (train, val) and (val, test) per group and feature with the suspicious flag; constant features are left out."""
    keys = [*by, "feature"]
    long = melt(df, [*by, "split"], features, "feature")
    ks = ks_pairs(long, keys, "value", "split", [("train", "val"), ("val", "test")])
    spread = lambda s: F.coalesce(F.stddev_pop(F.when(F.col("split") == s, F.col("value"))), F.lit(0.0))
    varied = long.groupBy(*keys).agg(spread("train").alias("_a"), spread("test").alias("_b")).filter("NOT (_a < 1e-9 AND _b < 1e-9)")
    return ks.join(varied.select(*keys), keys).withColumn(
        "suspicious", (F.col("ks_train_val") > low) & (F.col("ks_val_test") < high))


# ---- sample weights --------------------------------------------------------------------------------
# Weights depend on a row's cell only (bins of its value, per group). Cells are counted in one
# aggregate, weighted by windows over a group's few cells, and joined back on (group, cell).

def quantile_edges(df: DataFrame, value: str, count: int) -> list[float]:
    """``count + 1`` quantile edges of a whole table; edges may repeat on zero-inflated values."""
    return quantile_values(df, value, [i / count for i in range(count + 1)])


def edge_bin(x: Column, edges: Sequence[float] | Column, bins: int | None = None, widen: float = 1e-6) -> Column:
    """Number of edges at or below ``x`` minus one, inside [0, bins - 1]; the top edge is widened.

    Edges are numbers, or an array column whose top edge is widened already.
    """
    if not isinstance(edges, Column):
        bins = len(edges) - 1
        edges = F.array(*[F.lit(float(e)) for e in edges[:-1]], F.lit(float(edges[-1]) + widen))
    k = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return F.when(x.isNotNull(), F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1)))


def _with_edges(df: DataFrame, source: DataFrame, by: Sequence[str], value: str, bins: int, widen: float = 1e-6) -> DataFrame:
    """``_q``: the quantile bin of the value under its group's edges."""
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(source, by, value, names)
    table = edges.select(*by, F.array(*[F.col(n) + (widen if i == bins else 0.0) for i, n in enumerate(names)]).alias("_edges"))
    return df.join(table, list(by), "left").withColumn("_q", edge_bin(F.col(value), F.col("_edges"), bins)).drop("_edges")


def _with_span(df: DataFrame, source: DataFrame, by: Sequence[str], value: str, bins: int, widen: float = 0.0) -> DataFrame:
    """``_h``: the equal-width bin of the value between its group's ends, ``_in``: whether it lies between them."""
    span = source.groupBy(*by).agg(F.min(value).cast("double").alias("_lo"), (F.max(value).cast("double") + widen).alias("_hi"))
    x = F.col(value)
    return df.join(span, list(by), "left").withColumns({
        "_h": F.when(x.isNotNull(), bin_index(x, F.col("_lo"), F.col("_hi"), bins)), "_in": x.between(F.col("_lo"), F.col("_hi"))}).drop("_lo", "_hi")


def _counted(rows: DataFrame, keys: Sequence[str], samples: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("split") == s).alias(f"_n_{s}") for s in samples])


def _mean_one(cells: DataFrame, by: Sequence[str], raw: Column, n: str, extra: float = 0.0, out: str = "weight") -> DataFrame:
    """``raw`` divided by its mean over the group's rows, which the cell counts ``n`` already tell."""
    w = Window.partitionBy(*by)
    cells = cells.withColumn("_raw", raw)
    mean = F.sum(F.col("_raw") * F.col(n)).over(w) / F.nullif(F.sum(n).over(w), F.lit(0))
    return cells.withColumn(out, F.col("_raw") / (mean + extra)).drop("_raw")


def _share(c: str, by: Sequence[str]) -> Column:
    total = F.sum(c).over(Window.partitionBy(*by))
    return F.col(c) / F.greatest(total, F.lit(1))


def _joined(rows: DataFrame, cells: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """Rows of one split with their cell's weight; rows without a value have none."""
    same = rows.filter(F.col("split") == split)
    return same.join(cells.select(*keys, "weight"), list(keys), "left").drop(*[k for k in keys if k.startswith("_")], "_q", "_h", "_in")


def hist_reweight(df: DataFrame, value: str = "target", bins: int = 20, source: str = "val", goal: str = "test", by: Sequence[str] = ("disease",)) -> DataFrame:
    """Weights that give the source split the goal split's histogram in its group, inside [0.1, 10], mean 1."""
    two = df.filter(F.col("split").isin(source, goal))
    rows = _with_span(two, two, by, value, bins, 1e-9)
    keys = [*by, "_h"]
    cells = _counted(rows, keys, [source, goal])
    ratio_of = clip(_share(f"_n_{goal}", by) / F.nullif(_share(f"_n_{source}", by), F.lit(0.0)), 0.1, 10.0)
    return _joined(rows, _mean_one(cells, by, ratio_of, f"_n_{source}"), keys, source)


def inverse_root_weights(df: DataFrame, value: str = "target", bins: int = 10, by: Sequence[str] = ("disease",)) -> DataFrame:
    """1 / sqrt(count of the quantile bin) of the group's train rows, mean 1."""
    train = df.filter("split = 'train'")
    rows = _with_edges(train, train, by, value, bins)
    keys = [*by, "_q"]
    cells = _counted(rows, keys, ["train"])
    return _joined(rows, _mean_one(cells, by, 1 / F.sqrt("_n_train"), "_n_train"), keys, "train")


def blend_weights_20_80(df: DataFrame, value: str = "target", share: float = 0.8, bins: int = 20, by: Sequence[str] = ("disease",)) -> DataFrame:
    """``share`` inverse-frequency weight plus the rest from the group's val/train histogram ratio, on its train rows."""
    two = df.filter(F.col("split").isin("train", "val"))
    rows = _with_span(_with_edges(two, two.filter("split = 'train'"), by, value, bins), two.filter("split = 'val'"), by, value, bins)
    keys = [*by, "_q", "_h", "_in"]
    cells = _counted(rows, keys, ["train", "val"])
    hist = cells.filter("_in").groupBy(*by, "_h").agg(F.sum("_n_train").alias("_t"), F.sum("_n_val").alias("_v")).select(
        *by, "_h", clip(F.coalesce(_share("_v", by) / F.nullif(_share("_t", by), F.lit(0.0)), F.lit(1.0)), 0.2, 5.0).alias("_d"))
    # A train value beyond the val range falls into the outer bin and takes its ratio.
    cells = cells.filter("_n_train > 0").join(hist, [*by, "_h"], "left").withColumn("_d", F.coalesce("_d", F.lit(1.0)))
    cells = _mean_one(cells, by, 1 / F.sqrt(F.sum("_n_train").over(Window.partitionBy(*by, "_q"))), "_n_train", out="_freq")
    cells = _mean_one(cells, by, F.col("_d"), "_n_train", out="_dist")
    cells = _mean_one(cells, by, share * F.col("_freq") + (1.0 - share) * F.col("_dist"), "_n_train")
    return _joined(rows, cells, keys, "train")


def align_weights(df: DataFrame, value: str = "target", bins: int = 10, by: Sequence[str] = ("disease",)) -> DataFrame:
    """Train weights te_share / tr_share on quantile bins of the group's train and test rows together.

    Every bin counts at least one train row, bins without rows included.
    """
    two = df.filter(F.col("split").isin("train", "test"))
    rows = _with_edges(two, two, by, value, bins)
    keys = [*by, "_q"]
    cells = _counted(rows, keys, ["train", "test"]).filter("_q IS NOT NULL").withColumn("_f", F.greatest("_n_train", F.lit(1)))
    w = Window.partitionBy(*by)
    train_share = F.col("_f") / (F.sum("_f").over(w) + bins - F.count("*").over(w))
    return _joined(rows, _mean_one(cells, by, _share("_n_test", by) / train_share, "_n_train", 1e-9), keys, "train")


def zero_align_weights(df: DataFrame, value: str = "target", by: Sequence[str] = ("disease",)) -> DataFrame:
    """Train weights that move the group's share of zeros to the mean share of its val and test rows, inside [0.3, 4], mean 1."""
    samples = ["train", "val", "test"]
    rows = df.withColumn("_z", F.col(value) == 0)
    keys = [*by, "_z"]
    cells = _counted(rows, keys, samples).filter("_z IS NOT NULL")
    w = Window.partitionBy(*by)
    zeros = lambda s: F.sum(F.when(F.col("_z"), F.col(f"_n_{s}")).otherwise(0)).over(w) / F.greatest(F.sum(f"_n_{s}").over(w), F.lit(1))
    now, goal = F.greatest(zeros("train"), F.lit(1e-6)), F.greatest((zeros("val") + zeros("test")) / 2, F.lit(1e-6))
    raw = clip(F.when(F.col("_z"), goal / now).otherwise((1 - goal) / F.greatest(1 - now, F.lit(1e-6))), 0.3, 4.0)
    return _joined(rows, _mean_one(cells, by, raw, "_n_train"), keys, "train")


# ---- scales ------------------------------------------------------------------------------------------

def minmax_percentile(df: DataFrame, value: str = "target", low: float = 0.005, high: float = 0.995, by: Sequence[str] = ("disease",)) -> DataFrame:
    """Scale by two train quantiles of the group into [0, 1], and the value that the scaled one maps back to."""
    ends = exact_quantiles(df.filter("split = 'train'"), by, value, {"_lo": low, "_hi": high})
    gap = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    scaled = df.join(ends, list(by), "left").withColumn("scaled", clip((F.col(value) - F.col("_lo")) / gap, 0.0, 1.0))
    return scaled.withColumn("restored", F.col("scaled") * gap + F.col("_lo")).drop("_lo", "_hi")


def standardise(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("disease",)) -> DataFrame:
    """(x - mean) / population deviation with the group's train statistics; constant columns are only centred."""
    stats = df.filter("split = 'train'").groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scale = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    rows = df.join(stats, list(by), "left").withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns})
    return rows.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])
