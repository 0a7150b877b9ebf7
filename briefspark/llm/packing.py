"""Packing by the histogram of lengths: shortest pack first, longest lengths first.

The plan works on counts alone, so its size follows the sequence length and not the corpus: at
most one group of equal packs is split and one is opened for each length. Documents get their
places by rank: the k-th piece of a length takes the k-th place that the plan has for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm.shared import materialize, sums_before, table
from briefspark.llm.tokens import byte_encoder, public_path

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Pieces of one length that are ranked together; longer queues are dealt into buckets by hash.
RANKED_TOGETHER = 2_000


def cut_documents(docs: DataFrame, path: str, room: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``room`` ids of each text's encoding and ``end_id``; a null text is empty, and so one piece of one id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = byte_encoder(path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for ident, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    ids = encoder.encode(text or "") + end
                    total = len(ids) // 4
                    for start in range(0, total, room):
                        piece = ids[4 * start : 4 * (start + room)]
                        rows.append((ident, start, len(piece) // 4, zlib.crc32(piece), total))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def plan_packs(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Places as (length, first rank, count, first pack, offset): rank r of a length is in pack ``first pack + r - first rank``.

    Lengths are placed longest first, always into the packs that hold least so far; a group of
    equal packs is split when fewer pieces than packs are left.
    """
    by_space: dict[int, list[tuple[int, int]]] = {}  # space left: groups of (first pack, count)
    places: list[tuple[int, int, int, int, int]] = []
    packs = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = max((s for s, groups in by_space.items() if groups), default=-1)
            if space < length:  # as many new packs as what is left of this length fills
                opened = -(-left // (room // length))
                by_space.setdefault(room, []).append((packs, opened))
                packs += opened
                continue
            first, count = by_space[space].pop()
            used = min(count, left)
            if used < count:
                by_space[space].append((first + used, count - used))
            by_space.setdefault(space - length, []).append((first, used))
            places.append((length, rank, used, first, room - space))
            rank, left = rank + used, left - used
    return places


def place(pieces: DataFrame, room: int = 1024) -> DataFrame:
    """Give every piece (PIECES) its ``sequence_id`` and ``offset``; repeated rows get places of their own.

    A length that many pieces have is dealt into buckets by hash, each ranked by itself and moved
    on by what the buckets before it hold, which is summed in two levels. ``pieces`` is read three times and should be a written table.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``room`` rows
    buckets = spark.createDataFrame([(n, -(-c // RANKED_TOGETHER)) for n, c in histogram.items()], "length bigint, __buckets bigint")
    rows = pieces.join(F.broadcast(buckets), "length").withColumn("__b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("__buckets")))
    counts = materialize(rows.groupBy("length", "__b").agg(F.count("*").alias("__n")), "buckets")
    counts = sums_before(counts, ["length"], "__b", "__n", "__before")
    within = Window.partitionBy("length", "__b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = rows.withColumn("__k", F.row_number().over(within) - 1).join(counts, ["length", "__b"]).withColumn("__r", F.col("__k") + F.col("__before"))
    plan = spark.createDataFrame(plan_packs(histogram, room) or [(0, 0, 0, 0, 0)], "length bigint, __first bigint, __count bigint, __pack bigint, offset bigint")
    fits = (ranked["length"] == plan["length"]) & (F.col("__r") >= F.col("__first")) & (F.col("__r") < F.col("__first") + F.col("__count"))
    return ranked.join(F.broadcast(plan), fits).select("doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("__pack") + F.col("__r") - F.col("__first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None, room: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document, with its place in a sequence of at most ``room`` ids.

    An empty table gives no rows. Rows that share an id are packed as documents of their own; a
    null id stays null.
    """
    return place(materialize(cut_documents(docs, path or public_path("byte_bpe_50k.json"), room, id_col=id_col, text_col=text_col), "pieces"), room)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
