"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.plans.views import PanelViews

QUERIES: dict[str, Callable[[PanelViews], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[PanelViews], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def show(df: DataFrame, plain: Iterable[str] = (), floats: Iterable[str] = (), ints: Iterable[str] = (), digits: int = 6) -> DataFrame:
    """Output projection: plain columns, doubles rounded, counts as BIGINT."""
    return df.select(
        *plain,
        *[F.col(c).cast("bigint").alias(c) for c in ints],
        *[F.round(F.col(c).cast("double"), digits).alias(c) for c in floats],
    )


def out(plain: Iterable[str] = (), floats: Iterable[str] = (), ints: Iterable[str] = (), digits: int = 6) -> str:
    """The same projection as SQL text."""
    return ", ".join(
        [*plain, *[f"CAST({c} AS BIGINT) AS {c}" for c in ints],
         *[f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in floats]]
    )
