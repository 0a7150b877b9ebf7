"""Weekly averages of closing prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions.text import arrow, signed_percent, thousands

# What is reported, in order, with the digits shown.
SYMBOLS = [("S&P 500", "^GSPC", 2), ("Dow", "^DJI", 2), ("Nasdaq", "^IXIC", 2), ("WTI crude", "CL=F", 2), ("EUR/USD", "EURUSD=X", 4), ("GBP/USD", "GBPUSD=X", 4), ("USD/JPY", "JPY=X", 2)]
CHART = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>"


def closes(payloads: DataFrame, today: Column, body: str = "body") -> DataFrame:
    """(symbol, ts, close) from chart payloads: null closes go, then the last bar if its day isn't over."""
    result = F.get(F.from_json(F.col(body), CHART)["chart"]["result"], 0)
    bars = payloads.select("symbol", F.explode(F.arrays_zip(result["timestamp"].alias("ts"), F.get(result["indicators"]["quote"], 0)["close"].alias("close"))).alias("b")).select("symbol", "b.ts", "b.close").filter("close is not null")
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc())) == 1
    return bars.withColumn("__last", last).filter(~(F.col("__last") & (F.to_date(F.timestamp_seconds("ts")) >= today))).drop("__last")


def weekly_change(prices: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Per symbol the mean of its last five values, that of the five before, and the change in percent; fewer than ten give no row."""
    placed = prices.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).filter("__rn <= 10")
    means = placed.groupBy(by).agg(F.avg(F.when(F.col("__rn") <= 5, F.col(value))).alias("current"), F.avg(F.when(F.col("__rn") > 5, F.col(value))).alias("previous"), F.count("*").alias("__n")).filter("__n = 10").drop("__n")
    return means.withColumn("pct", (F.col("current") - F.col("previous")) / F.nullif("previous", F.lit(0.0)) * 100).filter("pct is not null")


def market_rows(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Formatted rows in the order of ``symbols`` (pos, label, symbol, digits)."""
    value = F.when(F.col("digits") == 4, thousands(F.col("current"), 4)).otherwise(thousands(F.col("current"), 2))
    return changes.join(symbols, "symbol").select("pos", "label", value.alias("value"), signed_percent(F.col("pct")).alias("pct"), arrow(F.col("pct")).alias("arrow"))


def market_lines(rows: DataFrame) -> DataFrame:
    """(pos, line) with labels and values in columns; there are as many rows as symbols."""
    width = Window.partitionBy()
    padded = rows.withColumns({"__l": F.max(F.length("label")).over(width), "__v": F.max(F.length("value")).over(width)})
    return padded.select("pos", F.concat(F.rpad("label", F.col("__l"), F.lit(" ")), F.lit("  "), F.lpad("value", F.col("__v"), F.lit(" ")), F.lit("  "), "arrow", F.lit(" "), "pct").alias("line"))
