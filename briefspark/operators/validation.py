"""Citations against what was fetched, and rules that drafts have to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions.text import first_nonempty


def filled(column: Column) -> Column:
    return F.length(F.trim(F.coalesce(column, F.lit("")))) > 0


def cited(citations: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Citations whose key is allowed, as it is written; duplicates among the allowed don't multiply rows."""
    return citations.join(allowed.select(*on), on, "left_semi")


def section_allowed(items: DataFrame, sections: DataFrame, group: str, section: str, key: str) -> DataFrame:
    """Allowed (section, key) pairs: each section may cite the items of its groups; the union is distinct."""
    return items.join(F.broadcast(sections), group).select(section, key).distinct()  # sections is a fixed table of a few rows


def without_citation(rows: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    return rows.join(citations.select(key), key, "left_anti")


def problems(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row (key, problem) for each rule that a row breaks; one pass over the rows."""
    broken = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda p: p.isNotNull())
    return rows.select(key, F.explode(broken).alias("problem"))


def digest_problems(topics: DataFrame, trends: DataFrame, headline: Column, heads: DataFrame, citations: DataFrame) -> DataFrame:
    """All that is wrong with drafts, by run: (run_id, problem). A draft is valid if it has no row.

    ``topics`` and ``trends`` have run_id and pos; ``citations`` (run_id, pos) are those allowed.
    """
    rules = {f"missing {c}": ~filled(F.col(c)) for c in ("title", "latest_developments", "summary")}
    at_topic = lambda df: df.select("run_id", F.concat(F.lit("topic "), F.col("pos").cast("string"), F.lit(": "), F.col("problem")).alias("problem"))
    broken = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda p: p.isNotNull())
    found = at_topic(topics.select("run_id", "pos", F.explode(broken).alias("problem")))
    uncited = topics.join(citations.select("run_id", "pos").distinct(), ["run_id", "pos"], "left_anti")
    found = found.union(at_topic(uncited.select("run_id", "pos", F.lit("no valid sources").alias("problem"))))
    found = found.union(heads.filter(~filled(headline)).select("run_id", F.lit("missing headline")))
    found = found.union(heads.join(topics.select("run_id"), "run_id", "left_anti").select("run_id", F.lit("missing topics")))
    good = trends.groupBy("run_id").agg(F.min(filled(F.col("text")).cast("int")).alias("ok")).filter("ok = 1")
    return found.union(heads.join(good, "run_id", "left_anti").select("run_id", F.lit("trends need text")))


def local_items(items: DataFrame, citations: DataFrame) -> DataFrame:
    """Local stories that have a title, a text and an allowed source; others are dropped, not reported."""
    whole = items.filter(filled(F.col("title")) & filled(F.col("latest_developments")))
    whole = whole.join(citations.select("section", "pos").distinct(), ["section", "pos"], "left_semi")
    return whole.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "latest_developments", "summary")})


def normalize_topics(topics: DataFrame) -> DataFrame:
    """Blank areas become Other; tags that aren't strings go."""
    return topics.withColumns({"area": first_nonempty(F.trim("area"), F.lit("Other")), "tags": F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())})
