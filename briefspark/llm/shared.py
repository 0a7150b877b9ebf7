"""Places that driver and executors share, and small helpers for rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='briefspark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage is cut and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """The pyarrow file system of a URI or plain path, and the path there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def local_copy(uri: str, cache: dict[str, str]) -> str:
    """A path that can be memory-mapped: the file itself if it is in a mounted folder, else a copy fetched once per worker."""
    system, path = file_system(uri)
    if system.type_name == "local":
        return path
    if uri not in cache:
        handle, cache[uri] = tempfile.mkstemp()
        with system.open_input_stream(path) as source, os.fdopen(handle, "wb") as out:
            while block := source.read(1 << 20):
                out.write(block)
    return cache[uri]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct: beside it columns may have any names without a clash."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias(name)


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread_on: list[Column], salts: int = 16) -> DataFrame:
    """Left equi-join that spreads the rows of a hot key over ``salts`` tasks; ``right`` has one row a key.

    ``right`` is repeated once per salt and never broadcast: Spark would judge by its size before that.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies.hint("merge"), [*keys, "__salt"], "left").drop("__salt")


def sums_before(rows: DataFrame, by: list[str], at: str, value: str, name: str, together: int = 1024) -> DataFrame:
    """``by``, ``at`` and, as ``name``, the sum of ``value`` over the rows of the same ``by`` at smaller places.

    ``at`` counts from 0. ``together`` places are summed in one task, then the totals of such blocks,
    so a key with n places has no more than n / ``together`` rows in one task. ``rows`` is read twice.
    """
    blocks = rows.select(*by, at, value, F.floor(F.col(at) / together).alias("__block"))
    above = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*by, "__block").agg(F.sum(value).alias("__total")).select(*by, "__block", F.coalesce(F.sum("__total").over(above), F.lit(0)).alias("__above"))
    inside = Window.partitionBy(*by, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, [*by, "__block"])
    return placed.select(*by, at, (F.col("__inside") + F.col("__above")).alias(name))
