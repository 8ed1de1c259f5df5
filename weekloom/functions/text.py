"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekloom.functions.dates import as_col


def slug(c: Column | str) -> Column:
    return F.replace(F.lower(as_col(c)), F.lit(" "), F.lit("_"))


def bool_from_text(c: Column | str) -> Column:
    t = F.trim(as_col(c))
    return F.when(t == "True", F.lit(True)).when(t == "False", F.lit(False))


def value_with_rounded(c: Column | str) -> Column:
    """``12.34 (12)``: two decimals and the nearest integer, halves to even."""
    x = as_col(c)
    return F.format_string("%.2f (%d)", x, F.bround(x, 0).cast("bigint"))


def value_with_bounds(c: Column | str) -> Column:
    """``12.34 (12 - 13) cases``."""
    x = as_col(c)
    return F.format_string("%.2f (%d - %d) cases", x, F.floor(x), F.ceil(x))
