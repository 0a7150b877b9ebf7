"""What changed since the last run, and what earlier runs covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions.text import first_nonempty, norm_text
from briefspark.operators.selection import keep_first


def last_text(stories: DataFrame, key: str, text: Column, seq: str) -> DataFrame:
    """(key, old_text): each key's last text in order of ``seq``, normalized."""
    return stories.filter(F.col(key) != "").groupBy(key).agg(F.max_by(norm_text(text), F.col(seq)).alias("old_text"))


def changes(current: DataFrame, prior: DataFrame, key: str, text: str) -> DataFrame:
    """Stories whose key is new or whose text differs from a prior text that isn't empty.

    ``new_text`` is as written, ``old_text`` normalized (null for new ones); the rest is dropped.
    """
    found = current.filter(F.col(key) != "").join(prior.withColumn("__known", F.lit(True)), key, "left")
    status = F.when(F.col("__known").isNull(), "new").when((F.col("old_text") != "") & (norm_text(F.col(text)) != F.col("old_text")), "updated")
    return found.withColumn("status", status).filter("status is not null").withColumn("new_text", F.coalesce(text, F.lit(""))).drop("__known")


def stacked(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Parts one below the other, each row with its section and the section's place."""
    return reduce(DataFrame.unionByName, (df.withColumns({"section": F.lit(name), "section_ord": F.lit(k)}) for k, (name, df) in enumerate(parts)))


def catalog(stories: DataFrame, changed: DataFrame, key: str = "anchor", gist: str = "gist", cap: int = 240) -> DataFrame:
    """Every story with its status: that of the change, else unchanged."""
    known = changed.groupBy(key).agg(F.first("status").alias("status"))
    return stories.filter(F.col(key).isNotNull()).join(known, key, "left").withColumns({"status": F.coalesce("status", F.lit("unchanged")), gist: F.substring(F.coalesce(gist, F.lit("")), 1, cap)})


def link_titles(trends: DataFrame, topics: DataFrame, trend_title: str, topic_title: str, pos: str, anchor: str) -> DataFrame:
    """``trends`` with the anchor of the first topic whose normalized title is theirs; null if none."""
    firsts = keep_first(topics.select(norm_text(F.col(topic_title)).alias("__t"), F.col(pos).alias("__pos"), F.col(anchor).alias("linked")).filter("__t <> '' and linked is not null"), ["__t"], [F.col("__pos")])
    return trends.withColumn("__t", norm_text(F.col(trend_title))).join(firsts.drop("__pos"), "__t", "left").drop("__t")


def within_days(rows: DataFrame, date: str, today: Column, days: int) -> DataFrame:
    """Rows dated at most ``days`` before ``today``; later ones stay. A filter on a partition column prunes."""
    return rows.filter(F.col(date) >= F.date_sub(today, days))


def prior_topics(topics: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Per day the topics that were covered: title, area and text, which has had three names."""
    text = first_nonempty(F.col("latest_developments"), F.col("last_24h"), F.col("summary"))
    return within_days(topics, "date", today, days).groupBy("date").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "area", text.alias("development")))).alias("topics"))


def history_line(title: Column, latest: Column) -> Column:
    title, latest = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(latest, F.lit("")))
    return F.concat_ws(" — ", F.nullif(title, F.lit("")), F.nullif(latest, F.lit("")))


def history(items: DataFrame, by: str, section: str, order: list[str], line: Column, sections: list[str]) -> DataFrame:
    """Per ``by`` a column of lines for each section, in order; empty lines go, and so do rows with no line."""
    lines = items.withColumn("__line", line).filter("__line <> ''").groupBy(by).pivot(section, sections).agg(F.sort_array(F.collect_list(F.struct(*order, "__line"))))
    return lines.select(by, *(F.transform(F.coalesce(F.col(f"`{s}`"), F.array()), lambda x: x["__line"]).alias(s) for s in sections))
