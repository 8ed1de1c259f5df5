"""Type repair, name cleaning, column selection and range checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.constants import DISTRICT_ALIASES, DISTRICTS_DROPPED
from weekloom.functions.dates import as_col


def clean_district(df: DataFrame, area: str = "district") -> DataFrame:
    """Drop names that are not districts, trim the rest and resolve spelling variants."""
    name = F.trim(area)
    fixed = name
    for wrong, right in DISTRICT_ALIASES.items():
        fixed = F.when(name == wrong, right).otherwise(fixed)
    return df.filter(~name.isin(*DISTRICTS_DROPPED)).withColumn(area, fixed)


def in_list(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows whose value is in a comma-separated list; an empty list keeps everything."""
    wanted = [w.strip() for w in (text or "").split(",") if w.strip()]
    return df.filter(F.col(column).isin(*wanted)) if wanted else df


def in_range(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Optional inclusive date bounds."""
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.filter(F.col(column) <= F.lit(last).cast("date"))
    return df


def columns_except(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]


def columns_matching(df: DataFrame, needles: Sequence[str], lagged: bool | None = None) -> list[str]:
    return [
        c for c in df.columns
        if any(n in c for n in needles) and (lagged is None or ("lag" in c) == lagged)
    ]


def align_columns(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns as doubles in the given order; absent columns and NULLs become 0."""
    have = set(df.columns)
    cell = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    return df.select(*keep, *[cell(c).alias(c) for c in wanted])


def column_category(name: Column | str) -> Column:
    """Six groups of panel columns, told by their names."""
    c = as_col(name)
    return (
        F.when(c.contains("_lag_"), "climate_lag")
        .when(c.rlike("^(T2M|RH2M|PRECTOTCORR)"), "climate")
        .when(c.rlike("^(month|monsoon|week_number|sin_week|cos_week)"), "season")
        .when(c.isin("leptospirosis", "typhus", "hepatitis_a", "chickenpox", "target"), "disease")
        .when(c.isin("district", "disease"), "key")
        .otherwise("time")
    )


def column_catalog(df: DataFrame) -> DataFrame:
    """(column, category, type, nulls, filled) from one pass over the table."""
    types = dict(df.dtypes)
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
            (F.count("*") - F.count(F.col(c))).alias("nulls"), F.count(F.col(c)).alias("filled"),
        )
        for c in df.columns
    ])
    return df.agg(cells.alias("cells")).select(F.inline("cells")).withColumn("category", column_category("column"))


def range_check(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """min, max and number of values outside the expected limits, per column, in one pass."""
    cells = []
    for c, (lo, hi) in limits.items():
        outside = F.lit(False)
        if lo is not None:
            outside = outside | (F.col(c) < lo)
        if hi is not None:
            outside = outside | (F.col(c) > hi)
        cells.append(F.struct(
            F.lit(c).alias("column"), F.min(c).cast("double").alias("lowest"), F.max(c).cast("double").alias("highest"),
            F.count_if(outside).alias("outside"),
        ))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def train_range_check(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Per feature and later split, how many values leave the train range. One pass for the range, one for the counts."""
    train = df.filter(F.col(split) == "train")
    span = train.agg(F.struct(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    )).scalar()
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.count_if((F.col(c) < span.getField(f"lo_{c}")) | (F.col(c) > span.getField(f"hi_{c}"))).alias("outside"),
        )
        for c in columns
    ])
    return df.filter(F.col(split) != "train").groupBy(split).agg(cells.alias("cells")).select(split, F.inline("cells"))


def finite_check(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Number of NaN or infinite cells per column (one pass)."""
    bad = lambda c: F.count_if(F.isnan(c) | (F.abs(c) == float("inf")))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bad(F.col(c).cast("double")).alias("not_finite")) for c in columns])
    return df.groupBy(*by).agg(cells.alias("cells")).select(*by, F.inline("cells"))


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, failing at run time on the first NaN or infinite cell."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & ~(F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.assert_true(F.coalesce(ok, F.lit(True)), F.lit("NaN or infinite feature")).isNull())


def monsoon_label(df: DataFrame) -> DataFrame:
    """Flags to one label; where several are set the later of NE, SW, IM2 wins."""
    return df.withColumn(
        "monsoon_season",
        F.when(F.col("monsoon_IM2"), "IM2").when(F.col("monsoon_SW"), "SW").when(F.col("monsoon_NE"), "NE").otherwise("None"),
    )
