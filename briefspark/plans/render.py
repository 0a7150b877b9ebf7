"""A briefing as ordered lines of text, and as HTML fragments; assembled where it is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions.text import escape_html, is_web, safe_url, wrapped

WIDTH = 64


def _sources(indent: str) -> Column:
    web = F.filter("sources", lambda s: is_web(s["url"]))
    return F.transform(web, lambda s: F.concat(F.lit(f"{indent}- "), s["source"], F.lit(": "), s["url"]))


def _lines(rows: DataFrame, section: Column, at: str, parts: Column) -> DataFrame:
    return rows.select("run_id", section.alias("section"), F.col(at).cast("long").alias("at"), F.posexplode(parts).alias("n", "line")).select("run_id", "section", F.struct("at", "n").alias("ord"), "line")


def topic_lines(topics: DataFrame, section: Column) -> DataFrame:
    """(run_id, section, ord, line) from numbered topics (rank, title, area, tags, latest_developments, summary, sources)."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")))
    head = wrapped(F.concat(F.col("rank").cast("string"), F.lit(". "), F.upper("title")), WIDTH, "", "   ")
    parts = F.concat(
        F.array(F.lit(""), head),
        F.array(wrapped(F.concat_ws(" · ", F.nullif("area", F.lit("")), tags), WIDTH, "   "), wrapped(F.concat(F.lit("Latest developments: "), "latest_developments"), WIDTH, "   "), wrapped(F.col("summary"), WIDTH, "   ")),
        _sources("   "),
    )
    return _lines(topics, section, "rank", parts)


def story_lines(stories: DataFrame, section: Column) -> DataFrame:
    parts = F.concat(F.array(wrapped(F.col("title"), WIDTH, "* ", "  "), wrapped(F.concat(F.lit("Latest developments: "), "latest_developments"), WIDTH, "  ")), F.when(F.col("summary") != "", F.array(wrapped(F.col("summary"), WIDTH, "  "))).otherwise(F.array().cast("array<string>")), _sources("  "))
    return _lines(stories, section, "pos", parts)


def glance_lines(entries: DataFrame, section: Column) -> DataFrame:
    """Entries with their kind, and the distinct titles of what they link."""
    label = F.concat(F.lit("["), F.upper("kind"), F.coalesce(F.concat(F.lit(" ("), "status", F.lit(")")), F.lit("")), F.lit("] "))
    titles = F.array_distinct(F.filter(F.transform("links", lambda x: x["title"]), lambda t: t != ""))
    see = F.when(F.size(titles) > 0, F.array(wrapped(F.concat(F.lit("see: "), F.array_join(titles, "; ")), WIDTH, "  "))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(wrapped(F.concat(label, "text"), WIDTH, "* ", "  ")), see)
    return _lines(entries, section, "pos", parts)


def plain_lines(rows: DataFrame, section: Column, first: str = "", rest: str = "") -> DataFrame:
    """Rows (run_id, pos, line) as they stand, wrapped."""
    return _lines(rows, section, "pos", F.array(wrapped(F.col("line"), WIDTH, first, rest)))


def team_lines(blocks: DataFrame, section: Column) -> DataFrame:
    """Teams (run_id, pos, team, record, games, next): each game with recap and page, then the next one."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    page = lambda url: part("url", F.when(is_web(url), url))
    head = F.concat(F.col("team"), F.when(F.col("record") != "", F.concat(F.lit(" ("), "record", F.lit(")"))).otherwise(""))
    played = F.transform("games", lambda g: F.array(part("item", F.concat(g["date"], F.lit(" · "), g["result"])), part("more", F.nullif(g["recap"], F.lit(""))), page(g["url"])))
    ahead = F.array(part("item", F.concat(F.lit("Up Next · "), F.col("next.matchup"), F.lit(" · "), F.col("next.when"))), page(F.col("next.url")))
    parts = F.filter(F.concat(F.array(part("head", F.lit("")), part("head", head)), F.coalesce(F.flatten(played), F.array().cast("array<struct<kind:string,text:string>>")), ahead), lambda x: x["text"].isNotNull())
    rows = blocks.select("run_id", F.col("pos").cast("long").alias("at"), F.posexplode(parts).alias("n", "p"))
    text, kind = F.col("p.text"), F.col("p.kind")
    line = F.when(kind == "item", wrapped(text, WIDTH, "  ", "    ")).when(kind == "more", wrapped(text, WIDTH, "    ")).when(kind == "url", F.concat(F.lit("    "), text)).otherwise(text)
    return rows.select("run_id", section.alias("section"), F.struct("at", "n").alias("ord"), line.alias("line"))


def _titles(titles: list[str]) -> Column:
    return F.create_map(*(F.lit(x) for k, t in enumerate(titles) for x in (k, t)))


def briefing(titles: list[str], *parts: DataFrame) -> DataFrame:
    """All parts' lines and, above each section that has any, its heading; ``section`` is a place in ``titles``."""
    lines = reduce(DataFrame.unionByName, parts)
    head = F.array(F.lit(""), F.upper(F.try_element_at(_titles(titles), F.col("section"))), F.lit("-" * WIDTH))
    heads = lines.select("run_id", "section").distinct().withColumn("at", F.lit(-1))
    return lines.unionByName(_lines(heads, F.col("section"), "at", head))


def contents(titles: list[str], lines: DataFrame) -> DataFrame:
    """Per run the titles of the sections that have lines."""
    present = lines.groupBy("run_id").agg(F.sort_array(F.collect_set("section")).alias("k"))
    return present.select("run_id", F.array_join(F.transform("k", lambda k: F.try_element_at(_titles(titles), k)), " | ").alias("contents"))


def linked_html(text: Column, links: Column) -> Column:
    """Escaped text with its links (ascending spans that don't overlap) as anchors; spans out of place are skipped."""
    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))
    fits = lambda a, x: (x["start"] >= a["at"]) & (x["end"] > x["start"]) & (x["end"] <= F.length(text))
    piece = lambda a, b: escape_html(F.substring(text, a + 1, b - a))
    step = lambda a, x: F.when(fits(a, x), F.struct(F.concat(a["html"], piece(a["at"], x["start"]), F.lit('<a href="#'), escape_html(x["anchor"]), F.lit('">'), piece(x["start"], x["end"]), F.lit("</a>")).alias("html"), x["end"].alias("at"))).otherwise(a)
    return F.aggregate(F.coalesce(links, F.array().cast("array<struct<anchor:string,phrase:string,start:int,end:int,title:string>>")), start, step, lambda a: F.concat(a["html"], escape_html(F.substring(text, a["at"] + 1, F.length(text)))))


def story_html(stories: DataFrame, *keys: str) -> DataFrame:
    """(run_id, keys.., pos, html) of stories; links that don't go to the web lead nowhere."""
    links = F.array_join(F.transform("sources", lambda s: F.concat(F.lit('<a rel="noopener" href="'), safe_url(s["url"]), F.lit('">'), escape_html(s["source"]), F.lit("</a>"))), ", ")
    body = F.concat(F.lit('<article id="'), F.coalesce("anchor", F.lit("")), F.lit('"><h3>'), escape_html(F.col("title")), F.lit("</h3><p>"), escape_html(F.col("latest_developments")), F.lit("</p><p>"), escape_html(F.coalesce("summary", F.lit(""))), F.lit("</p><p>"), links, F.lit("</p></article>"))
    return stories.select("run_id", *keys, "pos", body.alias("html"))


def page_html(title: str, titles: list[str], stories: DataFrame, entries: DataFrame, *others: DataFrame) -> DataFrame:
    """A whole page as ordered lines: head, contents, the list at the top, stories by section, other lines as they stand.

    ``stories`` and ``others`` have their section as a place in ``titles``; the list is section 0.
    """
    first, last = -2, len(titles)
    row = lambda df, section, at, line: df.select("run_id", F.lit(section).cast("int").alias("section") if isinstance(section, int) else section.cast("int").alias("section"), F.struct(at.cast("long").alias("at"), F.lit(0).alias("n")).alias("ord"), line.alias("line"))
    body = [row(entries, 0, F.col("pos"), F.concat(F.lit("<p>"), linked_html(F.col("text"), F.col("links")), F.lit("</p>"))), row(story_html(stories, "section"), F.col("section"), F.col("pos"), F.col("html"))]
    body += [df.select("run_id", F.col("section").cast("int").alias("section"), "ord", F.concat(F.lit("<pre>"), escape_html(F.col("line")), F.lit("</pre>")).alias("line")) for df in others]
    lines = reduce(DataFrame.unionByName, body)
    present = lines.select("run_id", "section").distinct()
    name = escape_html(F.try_element_at(_titles(titles), F.col("section")))
    heads = row(present, F.col("section"), F.lit(-1), F.concat(F.lit('<h2 id="s'), F.col("section").cast("string"), F.lit('">'), name, F.lit("</h2>")))
    contents = row(present, -1, F.col("section"), F.concat(F.lit('<a href="#s'), F.col("section").cast("string"), F.lit('">'), name, F.lit("</a>")))
    run = lines.sparkSession.createDataFrame([("run",)], "run_id string")
    start = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), escape_html(F.lit(title)), F.lit("</title></head><body><h1>"), escape_html(F.lit(title)), F.lit("</h1>"))
    edges = row(run, first, F.lit(0), start).unionByName(row(run, last, F.lit(0), F.lit("</body></html>")))
    return reduce(DataFrame.unionByName, [lines, heads, contents, edges])
