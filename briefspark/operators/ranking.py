"""Recency of topics, their order, and ids that stay the same from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def oldest_by_key(items: DataFrame, key: Column, time: str, name: str = "key") -> DataFrame:
    """(key, time) with each key's oldest time; empty keys and null times are left out."""
    return items.select(key.alias(name), time).filter((F.coalesce(name, F.lit("")) != "") & F.col(time).isNotNull()).groupBy(name).agg(F.min(time).alias(time))


def newest_of_sources(topics: DataFrame, sources: DataFrame, key: str, time: str, name: str = "recency") -> DataFrame:
    """``topics`` with the newest time among their sources (null if none) and the number of sources."""
    found = sources.groupBy(key).agg(F.max(time).alias(name), F.count("*").alias("n_sources"))
    return topics.join(found, key, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("long")))


def topic_rank(topics: DataFrame, by: list[str], recency: str, count: str, position: Column) -> DataFrame:
    """Rank: newest day first (none last), then most sources, then the order they came in."""
    order = [F.to_date(recency).desc_nulls_last(), F.col(count).desc(), position.asc()]
    return topics.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def by_first_appearance(topics: DataFrame, by: list[str], area: str, position: str) -> DataFrame:
    """Areas in the order of their first topic, topics in order within: ``area_pos`` and ``pos``."""
    firsts = topics.withColumn("area_pos", F.min(position).over(Window.partitionBy(*by, area)))
    return firsts.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("area_pos", position)))


def unique_anchors(rows: DataFrame, base: str, order: list[str], by: tuple[str, ...] = (), name: str = "anchor") -> DataFrame:
    """The second row with a base gets it with -2, the third with -3; a null base has no anchor."""
    n = F.row_number().over(Window.partitionBy(*by, base).orderBy(*order))
    return rows.withColumn("__n", n).withColumn(name, F.when(F.col(base).isNull(), None).when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("__n").cast("string")))).drop("__n")
