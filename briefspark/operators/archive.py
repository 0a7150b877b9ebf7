"""A store of run records by day, its retention and its index."""

from __future__ import annotations

import re
from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEM = r"^(\d{4}-\d{2}-\d{2})(?:-(\d{2})(\d{2}))?$"


def save_runs(runs: DataFrame, path: str) -> None:
    """Write records by ``run_date``; days that are written replace what was there, others stay."""
    runs.write.partitionBy("run_date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_runs(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Records, newest day first in effect of ``since`` pruning partitions; no upper bound."""
    runs = spark.read.parquet(path)
    return runs if since is None else runs.filter(F.col("run_date") >= since)


def latest_run(runs: DataFrame, time: str = "run_ts") -> DataFrame:
    """The one record that ran last, which may be an earlier one of today."""
    return runs.orderBy(F.col(time).desc()).limit(1)


def last_of_day(runs: DataFrame, time: str = "run_ts") -> DataFrame:
    whole = F.struct(*runs.columns)
    return runs.groupBy("run_date").agg(F.max_by(whole, time).alias("r")).select("r.*")


def save_page(lines: DataFrame, path: str) -> None:
    """Write a run's ordered lines (section, ord, line) as one text file; a page has a few hundred lines."""
    lines.coalesce(1).sortWithinPartitions("section", "ord").select("line").write.mode("overwrite").text(path)


def prior_count(runs: DataFrame) -> DataFrame:
    """Runs and topics that earlier coverage holds (rows with an array ``topics``)."""
    return runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.size("topics").cast("long")), F.lit(0)).alias("topics"))


def expired(rows: DataFrame, date: Column, today: Column, days: int) -> DataFrame:
    """Rows whose day is before the retention; none if ``days`` isn't positive."""
    return rows.filter((date < F.date_sub(today, days)) if days > 0 else F.lit(False))


def retained(rows: DataFrame, date: Column, today: Column, days: int) -> DataFrame:
    return rows.filter(~F.coalesce(date < F.date_sub(today, days), F.lit(False)) if days > 0 else F.lit(True))


def prune(spark: SparkSession, path: str, today: Date, days: int) -> list[str]:
    """Delete the store's days before the retention, and nothing else; gives what was deleted. None goes if ``days`` isn't positive."""
    if days <= 0:
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    first = (today - timedelta(days=days)).isoformat()
    found = {m[1]: status.getPath() for status in system.listStatus(root) if (m := re.fullmatch(r"run_date=(\d{4}-\d{2}-\d{2})", status.getPath().getName()))}
    gone = sorted(day for day in found if day < first)
    return [day for day in gone if system.delete(found[day], True)]


def stem_index(stems: DataFrame, stem: str = "stem") -> DataFrame:
    """Per day, newest first, the runs (stem, label), newest first; names that aren't of a run are left out."""
    s = F.col(stem)
    clock = F.regexp_extract(s, STEM, 2)
    label = F.when(clock == "", "briefing").otherwise(F.concat(clock, F.lit(":"), F.regexp_extract(s, STEM, 3)))
    return stems.filter(s.rlike(STEM)).groupBy(F.regexp_extract(s, STEM, 1).alias("day")).agg(F.sort_array(F.collect_list(F.struct(s.alias("stem"), label.alias("label"))), False).alias("runs")).orderBy(F.col("day").desc())
