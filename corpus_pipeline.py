"""From raw documents to packed training sequences, in four stages.

Each stage gets what the one before it kept, written as Parquet and read again, and returns the
columns of ``documents``; the last returns a row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from briefspark.llm.credentials import redact
from briefspark.llm.packing import pack_documents
from briefspark.llm.quality import quality_filter
from briefspark.llm.shared import materialize, table
from briefspark.llm.simhash import drop_near_duplicates


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of exact and near copies (SimHash and BK-trees, then five-word shingles at a similarity of 0.8 or more) the one with the smallest id stays."""
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are replaced in the text, and n_chars follows."""
    return redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", keep_good), ("near-dedup", keep_one_of_each), ("secret scan", mask_secrets), ("packing", pack)]

#: Tokenizers and fingerprints aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
