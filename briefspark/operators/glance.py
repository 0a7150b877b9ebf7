"""The short list at the top: themes and updates with phrases that link to stories.

What an entry may link depends on what entries before it have linked, so each run's few dozen
entries are folded in order by one task; runs are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 7
GLANCE = "run_id string, pos int, kind string, status string, text string, links array<struct<anchor:string,phrase:string,start:int,end:int,title:string>>"


def candidates(text: str, links) -> list[tuple[str, int, int]]:
    """(anchor, start, end) of every place where a link's phrase stands, by link and then by place; case doesn't count."""
    wanted = [(link["anchor"], (link["phrase"] or "").strip()) for link in (() if links is None else links)]
    return [(anchor, *m.span()) for anchor, phrase in wanted if phrase for m in re.finditer(re.escape(phrase), text, re.IGNORECASE)]


def take(text: str, found: list[tuple[str, int, int]], open_to: set[str]) -> dict[str, tuple[int, int]]:
    """One place for each anchor in ``open_to``: the first that no anchor before it covers."""
    covered, places = bytearray(len(text)), {}
    for anchor, start, end in found:
        if anchor in open_to and anchor not in places and not any(covered[start:end]):
            covered[start:end] = bytes([1]) * (end - start)
            places[anchor] = (start, end)
    return places


def entries_of_run(entries: list[dict], stories: dict[str, dict]) -> Iterator[dict]:
    """Entries in order with their links placed; each story is linked by the first entry that can."""
    left = set(stories)
    for entry in entries:
        text = (entry["text"] or "").strip()
        places = take(text, candidates(text, entry["links"]), left)
        if not text or entry["kind"] == "Update" and not places:
            continue
        left -= places.keys()
        links = [{"anchor": a, "phrase": text[i:j], "start": i, "end": j, "title": stories[a]["title"] or ""} for a, (i, j) in sorted(places.items(), key=lambda p: p[1])]
        told = stories[links[0]["anchor"]]["status"] if entry["kind"] == "Update" else None
        yield {"kind": entry["kind"], "status": told if told in ("new", "updated") else None, "text": text, "links": links}


def glance(entries: DataFrame, catalog: DataFrame, limit: int = LIMIT) -> DataFrame:
    """At most ``limit`` entries a run. ``entries``: run_id, pos, kind, text, links(anchor, phrase); ``catalog``: run_id, anchor, title, status.

    No story is linked twice in a run. Updates that link nothing are dropped, themes are not.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        stories = {r.anchor: {"title": r.title, "status": r.status} for r in right.itertuples()}
        rows = islice(entries_of_run(left.sort_values("pos").to_dict("records"), stories), limit)
        return pd.DataFrame([{"run_id": key[0], "pos": k, **r} for k, r in enumerate(rows)], columns=["run_id", "pos", "kind", "status", "text", "links"])

    entries = entries.withColumn("kind", F.when(F.col("kind").isin("Trend", "Update"), F.col("kind")).otherwise("Update"))
    return entries.groupBy("run_id").cogroup(catalog.groupBy("run_id")).applyInPandas(run, GLANCE)


def plain_entries(trends: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries without a language model: every trend with its topic (run_id, pos, text, linked, link_phrase), then every change (run_id, pos, title, anchor)."""
    links = "array<struct<anchor:string,phrase:string>>"
    first = trends.select("run_id", F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("at")).alias("o"), F.lit("Trend").alias("kind"), "text", F.when(F.col("linked").isNotNull(), F.array(F.struct(F.col("linked").alias("anchor"), F.coalesce("link_phrase", F.lit("")).alias("phrase")))).otherwise(F.array().cast(links)).cast(links).alias("links"))
    then = changed.select("run_id", F.struct(F.lit(1).alias("part"), F.col("pos").cast("long").alias("at")).alias("o"), F.lit("Update").alias("kind"), F.col("title").alias("text"), F.array(F.struct("anchor", F.col("title").alias("phrase"))).cast(links).alias("links"))
    both = first.unionByName(then)
    return both.withColumn("pos", F.col("o.part").cast("long") * (1 << 40) + F.col("o.at")).drop("o")
