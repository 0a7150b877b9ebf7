"""The log of items ever seen, fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: list[str], time: str | None = None, within: str | None = None) -> DataFrame:
    """Each key once. Without ``within`` the state holds all keys ever seen; with it those of so long a time."""
    if within:
        return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def append_log(stream: DataFrame, path: str, checkpoint: str, key: list[str]):
    """Process what is there, append unseen items to the log at ``path``, and stop: started again it goes on from there."""
    return first_seen(stream, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, group: str, time: str, late: str = "2 hours") -> DataFrame:
    """Items per group and hour of publication, with late items up to ``late``."""
    return stream.withWatermark(time, late).groupBy(group, F.window(time, "1 hour")).agg(F.count("*").alias("n")).select(group, F.col("window.start").alias("hour"), "n")
