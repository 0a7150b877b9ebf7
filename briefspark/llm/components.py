"""Connected components of links by alternating large and small stars, without collecting a node's links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.llm.shared import materialize, salted_left_join


def _smallest(links: DataFrame) -> DataFrame:
    """(u, v, m): each row of ``links`` with the least neighbour of u; rows of a hot u are dealt over many tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return salted_left_join(links, least, ["u"], [F.col("v")])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = _smallest(links)
    return down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) for every linked node but the least of its component, v being that least node.

    ``links`` has columns u > v of an ordered type. The rounds grow with the logarithm of a
    component's width; each is written to the shared folder, so a lost executor costs one round.
    """
    state = None
    links = materialize(links.select("u", "v").distinct(), name)
    while True:
        found = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            return links
        state = found
        links = materialize(_small_star(_large_star(links)), name)
