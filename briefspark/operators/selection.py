"""Which items of a stream are recent enough, distinct, and among the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions.text import title_key


def recent(items: DataFrame, now: Column, hours: Column | int, time: str = "published", slack_hours: int = 2) -> DataFrame:
    """Rows from ``hours`` before ``now`` up to a slack after it, both ends included; null times go."""
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return items.filter(F.col(time).between(now - F.make_dt_interval(hours=hours), now + F.make_dt_interval(hours=F.lit(slack_hours))))


def keep_first(rows: DataFrame, by: list[str | Column], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Tasks keep one row per key before the shuffle. Columns may have any names."""
    rank = "__rn"
    while rank in rows.columns:
        rank += "_"
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)


def newest_per_group(rows: DataFrame, by: list[str], order: list[Column], cap: int | Column, rank: str = "rank") -> DataFrame:
    """The first ``cap`` rows of each group, with their rank; tasks keep that many before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= cap)


def recent_items(items: DataFrame, now: Column, hours: int, cap: int, group: str = "group", title: str = "title", time: str = "published", ties: tuple[str, ...] = ("source", "url")) -> DataFrame:
    """Per group: recent items, one per squashed title (the newest), newest first, at most ``cap``.

    Equal times are ordered by ``ties``, so that results don't depend on arrival.
    """
    order = [F.col(time).desc(), *(F.col(t).asc() for t in ties)]
    distinct = keep_first(recent(items, now, hours, time).withColumn("__key", title_key(F.col(title))), [group, "__key"], order)
    return newest_per_group(distinct.drop("__key"), [group], order, cap)


def adaptive_window(items: DataFrame, now: Column, short: int, long: int, least: int, cap: int, group: str = "group", title: str = "title", time: str = "published", ties: tuple[str, ...] = ("source", "url")) -> DataFrame:
    """Like recent_items over ``short`` hours, or ``long`` for groups with fewer than ``least`` items in those.

    One pass: a title's newest item is the same in both windows, so one deduplication serves both.
    """
    order = [F.col(time).desc(), *(F.col(t).asc() for t in ties)]
    distinct = keep_first(recent(items, now, long, time).withColumn("__key", title_key(F.col(title))), [group, "__key"], order).drop("__key")
    inside = F.col(time) >= now - F.make_dt_interval(hours=F.lit(short))
    counts = distinct.groupBy(group).agg(F.least(F.count_if(inside), F.lit(cap)).alias("__n"))
    hours = counts.select(group, F.when(F.col("__n") < least, F.lit(long)).otherwise(F.lit(short)).alias("window_hours"))
    chosen = distinct.join(hours, group).filter((F.col("window_hours") == long) | inside)
    return newest_per_group(chosen, [group], order, cap)


def corpus(items: DataFrame, time: str = "published") -> DataFrame:
    """What is handed to a summarizer."""
    return items.select("source", "title", "url", F.concat(F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("published"), "summary")
