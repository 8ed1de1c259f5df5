"""JSON payloads of the climate services, parsed with ``from_json``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.constants import CLIMATE_VARIABLES
from weekloom.functions.dates import epoch_date

DAILY = "properties struct<parameter: map<string, map<string, double>>>"
MAIN = "main struct<temp: double, temp_max: double, temp_min: double, humidity: double>"
RAIN = "rain struct<`1h`: double, `3h`: double>"
READINGS = f"list array<struct<dt: bigint, {MAIN.replace(' ', ': ', 1)}, {RAIN.replace(' ', ': ', 1)}>>"
CURRENT = f"dt bigint, {MAIN}, {RAIN}, weather array<struct<description: string>>"


def daily_series(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``properties.parameter{P: {yyyymmdd: v}}`` to one row per day; absent parameters give NULL."""
    parameter = F.from_json(payload, DAILY).getField("properties").getField("parameter")
    df = df.withColumn("_p", parameter)
    days = F.array_distinct(F.flatten(F.transform(F.map_values("_p"), lambda m: F.map_keys(m))))
    df = df.withColumn("_k", F.explode(days))
    value = lambda v: F.try_element_at(F.try_element_at(F.col("_p"), F.lit(v)), F.col("_k"))
    return df.withColumns(
        {"d": F.to_date("_k", "yyyyMMdd"), **{v: value(v) for v in CLIMATE_VARIABLES}}
    ).drop("_p", "_k", payload)


def _measures(item, both_rains: bool) -> dict:
    main, rain = item.getField("main"), item.getField("rain")
    hour = rain.getField("1h")
    wet = F.coalesce(F.nullif(hour, F.lit(0.0)), rain.getField("3h")) if both_rains else hour
    return {
        "d": epoch_date(item.getField("dt")),
        "T2M": main.getField("temp"),
        "T2M_MAX": F.coalesce(main.getField("temp_max"), main.getField("temp")),
        "T2M_MIN": F.coalesce(main.getField("temp_min"), main.getField("temp")),
        "RH2M": main.getField("humidity"),
        "PRECTOTCORR": F.coalesce(wet, F.lit(0.0)),
    }


def reading_list(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``list[]`` of readings to rows; rain falls back from one to three hours to 0."""
    df = df.withColumn("_i", F.explode(F.from_json(payload, READINGS).getField("list")))
    return df.withColumns(_measures(F.col("_i"), True)).drop("_i", payload)


def current_reading(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One current-weather document to one row."""
    df = df.withColumn("_i", F.from_json(payload, CURRENT))
    note = F.try_element_at(F.col("_i").getField("weather"), F.lit(1)).getField("description")
    return df.withColumns({**_measures(F.col("_i"), False), "description": note}).drop("_i", payload)
