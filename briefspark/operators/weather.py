"""Forecast periods as lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORECAST = "properties struct<periods:array<struct<name:string,shortForecast:string,isDaytime:boolean,temperature:int,temperatureUnit:string>>>"

LINE_CHARS = 200


def period_line(p: Column) -> Column:
    hilo = F.when(F.coalesce(p["isDaytime"], F.lit(False)), "high").otherwise("low")
    return F.concat(p["name"], F.lit(": "), p["shortForecast"], F.lit(", "), hilo, F.lit(" "), p["temperature"].cast("string"), p["temperatureUnit"], F.lit("."))


def weather_lines(payloads: DataFrame, body: str = "body", periods: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(keys.., pos, line) of each payload's first periods."""
    found = F.from_json(F.col(body), FORECAST)["properties"]["periods"]
    return payloads.select(*keys, F.posexplode(F.transform(F.slice(found, 1, periods), lambda p: F.substring(period_line(p), 1, LINE_CHARS))).alias("pos", "line"))
