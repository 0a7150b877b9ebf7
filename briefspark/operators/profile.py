"""When feeds publish: an append-only log and the report on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions.dates import eastern, hours_between
from briefspark.operators.selection import keep_first

WEEKEND = ("Saturday", "Sunday")


def unseen(items: DataFrame, log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Items whose key isn't in the log, the first of each key. The items are cut down before they meet the log."""
    return keep_first(items, key, order).join(log.select(*key), key, "left_anti")


def log_rows(items: DataFrame, first_seen: Column) -> DataFrame:
    """Items as rows of the log; those without a URL or a date are left out."""
    local = eastern(F.col("published"))
    return items.withColumn("url", F.trim(F.coalesce("url", F.lit("")))).filter("url <> '' and published is not null").select("url", F.col("source").alias("feed"), "group", F.col("published").alias("published_utc"), F.hour(local).alias("published_et_hour"), F.date_format(local, "EEEE").alias("published_weekday"), first_seen.alias("first_seen_utc"))


def run_row(spark, timestamp, attempted: int, failed: list[str], added: int) -> DataFrame:
    return spark.createDataFrame([(timestamp, attempted, len(failed), failed, added)], "timestamp timestamp, feeds_attempted int, feeds_failed int, failed_names array<string>, new_items_added int")


def hour_histogram(rows: DataFrame, hour: str, width: int = 40) -> DataFrame:
    """24 rows (hour, n, bar); bars are scaled to the peak, at least one mark for a count above zero."""
    counts = rows.filter(F.col(hour).between(0, 23)).groupBy(F.col(hour).cast("int").alias("hour")).agg(F.count("*").alias("n"))
    dense = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    peak = F.max("n").over(Window.partitionBy())  # over 24 rows
    bar = F.when(F.col("n") > 0, F.repeat(F.lit("#"), F.greatest(F.lit(1), F.bround(F.lit(width) * F.col("n") / peak).cast("int")))).otherwise("")
    return dense.withColumn("bar", bar)


def with_total(rows: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """The aggregates of each group and, as ALL, of all rows; a group that is null is not the total."""
    found = rows.rollup(group).agg(*aggregates, F.grouping_id().alias("__g"))
    return found.withColumn(group, F.when(F.col("__g") == 1, "ALL").otherwise(F.col(group))).drop("__g")


def listed(found: DataFrame, group: str, groups: list[str], *counts: str) -> DataFrame:
    """A row for each of ``groups`` and ALL, whether it has items or not; counts are 0 and the rest null where there are none."""
    names = found.sparkSession.createDataFrame([(g,) for g in [*groups, "ALL"]], f"`{group}` string")
    return names.join(found, group, "left").fillna(0, list(counts))


def block_share(rows: DataFrame, group: str, hour: str) -> DataFrame:
    """Per group and ALL: percent of items in each four-hour block and their number; null where there are none."""
    blocks = [F.count_if(F.col(hour).between(4 * b, 4 * b + 3)).alias(f"__b{b}") for b in range(6)]
    counts = with_total(rows, group, *blocks, F.count_if(F.col(hour).between(0, 23)).alias("n"))
    names = [f"h{4 * b:02d}_{4 * b + 4:02d}" for b in range(6)]
    return counts.select(group, *(F.when(F.col("n") > 0, F.bround(100 * F.col(f"__b{b}") / F.col("n"), 0)).alias(name) for b, name in enumerate(names)), "n")


def weekday_split(rows: DataFrame, group: str, weekday: str) -> DataFrame:
    """Per group and ALL: items on weekdays and at weekends; rows without a day count in neither."""
    return with_total(rows, group, F.count_if(F.col(weekday).isNotNull() & (F.col(weekday) != "") & ~F.col(weekday).isin(*WEEKEND)).alias("weekday"), F.count_if(F.col(weekday).isin(*WEEKEND)).alias("weekend"))


def lag_report(rows: DataFrame, group: str, earlier: str, later: str) -> DataFrame:
    """Per group and ALL: exact median and nearest-rank 90th percentile of the lag in hours, and the number of rows.

    Lags are counted by value, the counts summed by minute, and only the minutes that hold a wanted
    rank are sorted. So a task sorts as many rows as the lags span minutes, or as one minute has values.
    """
    lag = rows.select(F.col(group).alias("g"), hours_between(F.col(earlier), F.col(later)).alias("lag")).filter("lag is not null")
    counts = lag.groupBy("g", "lag").agg(F.count("*").alias("c"))
    everything = counts.groupBy("lag").agg(F.sum("c").alias("c")).select(F.lit("ALL").alias("g"), "lag", "c")
    both = counts.unionByName(everything).withColumn("minute", F.floor(F.col("lag") * 60))
    whole = Window.partitionBy("g")
    n, ninth = F.col("n"), F.bround(F.col("n") * 0.9).cast("long")
    ranks = F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1, F.least(n, F.greatest(F.lit(1), ninth)))
    minutes = both.groupBy("g", "minute").agg(F.sum("c").alias("c")).withColumns({"upto": F.sum("c").over(whole.orderBy("minute")), "n": F.sum("c").over(whole)})
    wanted = minutes.select(F.col("g").alias("wg"), F.col("minute").alias("wm"), "n", "upto", (F.col("upto") - F.col("c")).alias("before"), F.posexplode(ranks).alias("kind", "rank"))
    wanted = wanted.filter("rank > before and rank <= upto").drop("upto")  # three rows a group
    near = both.join(wanted, F.col("g").eqNullSafe(F.col("wg")) & (F.col("minute") == F.col("wm")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "kind").orderBy("lag"))
    found = near.withColumn("upto", upto).filter("upto >= rank").groupBy("g", "kind").agg(F.min("lag").alias("lag"), F.max("n").alias("n"))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("lag")))
    return found.groupBy(F.col("g").alias(group)).agg(((at(0) + at(1)) / 2).alias("median_hours"), at(2).alias("p90_hours"), F.max("n").alias("n"))


def date_span(rows: DataFrame, time: str) -> DataFrame:
    lo, hi = F.min(time), F.max(time)
    return rows.agg(F.to_date(lo).alias("first_day"), F.to_date(hi).alias("last_day"), (hours_between(lo, hi) / 24).alias("span_days"), F.count("*").alias("n"))
