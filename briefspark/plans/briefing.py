"""A whole run: from feed rows to stories, their changes since the last run, and the rendered text.

Stories of all sections are rows of one table: run_date, run_ts, section, section_ord, pos, title,
area, tags, latest_developments, summary, sources, url, anchor, recency. What writes the stories is
a ``Summarizer``; the default one is plain clustering, so a run needs nothing but its feeds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.functions.text import first_nonempty, norm_url, title_key
from briefspark.functions.text import anchor as anchor_of
from briefspark.functions.dates import eastern
from briefspark.operators import archive, diffing, glance, market, ranking, selection, sports, validation, weather
from briefspark.plans import render
from briefspark.sources.feeds import feed_health, feed_items


@dataclass(frozen=True)
class Policy:
    """How far a group of feeds is looked back, and how many items are taken."""

    group: str
    hours: int
    cap: int


# Lookback hours and caps of the groups, and the section that each group's items go to.
SECURITY = Policy("security", 24, 120)
WIDER_HOURS, LEAST_ITEMS, LEAST_FEEDS, RETENTION_DAYS = 48, 12, 2, 90
POLICIES = [Policy("pittsburgh", 48, 60), Policy("reading", 336, 12), Policy("bizpol", 36, 60), Policy("events", 120, 50), Policy("sports_media", 96, 30), Policy("team_usa", 72, 40)]
SECTIONS = [("Security", "security"), ("Business and Politics", "bizpol"), ("Around Town", "pittsburgh"), ("Events", "events"), ("Around the Teams", "sports_media"), ("Team USA", "team_usa"), ("Reading", "reading")]
# Of these sections at least one has a story where the group has items.
WANTED = {"pittsburgh": ("Business and Politics", "Around Town", "Events"), "reading": ("Reading",)}
# Which groups' items a section may cite.
CITES = [(s, g) for s, g in SECTIONS] + [("Events", "pittsburgh")]

@dataclass(frozen=True)
class Notes:
    """What a summarizer is told beside the items: what was wrong with its last draft, and the topics of the days before."""

    problems: tuple[str, ...] = ()
    memory: DataFrame | None = None  # date, topics


Summarizer = Callable[[DataFrame, Notes], DataFrame]
MEMORY_DAYS = 7
STORY = ["section", "section_ord", "pos", "title", "area", "tags", "latest_developments", "summary", "sources"]


#: Sections of a page in their order; those of stories have the names in SECTIONS.
PAGE = ["Emerging Trends and Key Updates", "Security", "Business and Politics", "Weather", "Around Town", "Events", "Sports", "Around the Teams", "Team USA", "Reading", "Markets (weekly average, change vs prior week)"]


@dataclass(frozen=True)
class Extras:
    """API payloads that a page shows beside its stories; what is None isn't shown."""

    markets: DataFrame | None = None  # symbol, body
    forecast: DataFrame | None = None  # body
    boards: DataFrame | None = None  # league, board, body
    teams: DataFrame | None = None  # pos, league, team, record
    team: str = "PIT"


class Unfit(ValueError):
    """Feeds or drafts that no briefing can be made of, with all that is wrong."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = tuple(problems)


def select_items(items: DataFrame, now) -> DataFrame:
    """All groups' items by their policies: security in the window that holds enough, the others in theirs."""
    main = selection.adaptive_window(items.filter(F.col("group") == SECURITY.group), now, SECURITY.hours, WIDER_HOURS, LEAST_ITEMS, SECURITY.cap)
    out = main.drop("window_hours")
    hours = F.create_map(*(F.lit(x) for p in POLICIES for x in (p.group, p.hours)))
    caps = F.create_map(*(F.lit(x) for p in POLICIES for x in (p.group, p.cap)))
    rest = items.filter(F.col("group").isin([p.group for p in POLICIES]))
    chosen = selection.recent(rest, now, F.try_element_at(hours, F.col("group")))
    order = [F.col("published").desc(), F.col("source"), F.col("url")]
    chosen = selection.keep_first(chosen.withColumn("__key", title_key(F.col("title"))), ["group", "__key"], order).drop("__key")
    return out.unionByName(selection.newest_per_group(chosen, ["group"], order, F.try_element_at(caps, F.col("group"))))


def cluster(items: DataFrame, notes: Notes = Notes(), most_topics: int = 6, most_sources: int = 4) -> DataFrame:
    """Stories without a language model: items of a group that share their most common long title word.

    The newest item of a cluster gives title and text; its sources are the newest few. Security
    has at most ``most_topics`` stories, the most recent and most covered. It has no use for ``notes``.
    """
    words = items.select("group", "url", F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"))).alias("word")).filter("length(word) >= 5")
    shared = words.groupBy("group", "word").agg(F.count("*").alias("n")).filter("n > 1")
    named = words.join(shared, ["group", "word"]).groupBy("group", "url").agg(F.min_by("word", F.struct((-F.col("n")).alias("n"), "word")).alias("word"))
    keyed = items.join(named, ["group", "url"], "left").withColumn("key", F.coalesce("word", "url"))
    newest = F.sort_array(F.collect_list(F.struct("published", "title", "summary", "source", "url")), False)
    topics = keyed.groupBy("group", "key").agg(F.slice(newest, 1, most_sources).alias("top"), F.max("published").alias("newest"), F.count("*").alias("n"), F.first("word").alias("word"))
    sections = items.sparkSession.createDataFrame([(s, k, g) for k, (s, g) in enumerate(SECTIONS)], "section string, section_ord int, group string")
    placed = selection.newest_per_group(topics.join(F.broadcast(sections), "group"), ["section"], [F.to_date("newest").desc(), F.col("n").desc(), F.col("newest").desc(), F.col("key")], F.when(F.col("section_ord") == 0, most_topics).otherwise(60), "pos")
    first = F.get("top", 0)
    return placed.select(
        "section", "section_ord", "pos", first["title"].alias("title"), first["source"].alias("area"),
        F.when(F.col("word").isNotNull(), F.array("word")).otherwise(F.array().cast("array<string>")).alias("tags"),
        first_nonempty(first["summary"], first["title"]).alias("latest_developments"),
        F.concat(F.when(F.col("n") == 1, "1 item").otherwise(F.concat(F.col("n").cast("string"), F.lit(" items"))), F.lit(", the newest of "), F.date_format("newest", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("summary"),
        F.transform("top", lambda t: F.struct(t["source"].alias("source"), t["title"].alias("title"), t["url"].alias("url"))).alias("sources"),
    )


def allowed_sources(stories: DataFrame, items: DataFrame) -> DataFrame:
    """(section, pos, sources) of stories that cite what was fetched for their section; other sources are left out."""
    mapping = items.sparkSession.createDataFrame(CITES, "section string, group string")
    allowed = validation.section_allowed(items.select("group", "url"), mapping, "group", "section", "url")
    cited = stories.select("section", "pos", F.posexplode("sources").alias("n", "s")).select("section", "pos", "n", "s", F.col("s.url").alias("url"))
    return validation.cited(cited, allowed, ["section", "url"]).groupBy("section", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("sources"))


def allowed_stories(stories: DataFrame, items: DataFrame) -> DataFrame:
    """Stories that have a title, a text and an allowed source; ``check`` tells which of Security's are missing and why."""
    whole = stories.filter(validation.filled(F.col("title")) & validation.filled(F.col("latest_developments")))
    return validation.normalize_topics(whole.drop("sources").join(allowed_sources(stories, items), ["section", "pos"]))


def check(health: DataFrame, drafted: DataFrame, stories: DataFrame, items: DataFrame) -> None:
    """Raise Unfit with all that is wrong, in order: feeds, each Security topic's fields and sources, whole sections.

    Local sections and reading may not be empty where there are items for them. A draft has a page's rows.
    """
    loaded = {r["group"]: r["loaded"] for r in health.collect()}  # one row a group
    problems = [f"only {loaded.get(SECURITY.group, 0)} security feeds loaded"] if loaded.get(SECURITY.group, 0) < LEAST_FEEDS else []
    topics = drafted.filter("section_ord = 0")
    rules = {f"missing {c}": ~validation.filled(F.col(c)) for c in ("title", "latest_developments", "summary")}
    uncited = topics.join(allowed_sources(topics, items), ["section", "pos"], "left_anti").select("pos", F.lit("no valid sources").alias("problem"))
    problems += [f"topic {r['pos']}: {r['problem']}" for r in validation.problems(topics, "pos", rules).unionByName(uncited).orderBy("pos", "problem").collect()]
    found = {r["section"] for r in stories.select("section").distinct().collect()}
    groups = {r["group"] for r in items.select("group").distinct().collect()}
    if SECTIONS[0][0] not in found:
        problems.append("missing topics")
    problems += [f"{', '.join(sections)}: no story, though there are items" for group, sections in WANTED.items() if group in groups and not found & set(sections)]
    if problems:
        raise Unfit(problems)


def finish(stories: DataFrame, items: DataFrame, now: datetime) -> DataFrame:
    """Order security stories by recency and coverage, and give every story its anchor."""
    index = ranking.oldest_by_key(items.filter(F.col("group") == SECURITY.group), norm_url(F.col("url")), "published", "url")
    sources = stories.select("section", "pos", F.explode("sources").alias("s")).select("section", "pos", norm_url(F.col("s.url")).alias("url")).join(index, "url", "left")
    recency = sources.groupBy("section", "pos").agg(F.max("published").alias("recency"), F.count("*").alias("n_sources"))
    areas = ranking.by_first_appearance(stories, ["section"], "area", "pos").withColumnRenamed("pos", "area_rank")
    found = areas.join(stories.select("section", "anchor_key", "pos"), ["section", "anchor_key"]).join(recency, ["section", "pos"])
    security = ranking.topic_rank(found.filter("section_ord = 0"), ["section"], "recency", "n_sources", F.col("area_rank")).drop("pos").withColumnRenamed("rank", "pos")
    others = found.filter("section_ord > 0").withColumn("recency", F.lit(None).cast("timestamp"))
    both = security.select(*STORY, "recency").unionByName(others.select(*STORY, "recency"))
    both = both.withColumn("url", F.get("sources", 0)["url"]).withColumn("base", anchor_of(F.col("url")))
    both = ranking.unique_anchors(both, "base", ["section_ord", "pos"]).drop("base")
    return both.withColumns({"run_ts": F.lit(now), "run_date": F.lit(now.strftime("%Y-%m-%d"))})


def compare(stories: DataFrame, prior: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(changes, catalog) of stories against those of the run before; without one nothing has changed."""
    key = lambda df: df.withColumn("key", norm_url(F.col("url"))).withColumn("seq", F.struct("section_ord", "pos"))
    now = key(stories)
    before = (now.limit(0) if prior is None else key(prior)).select("key", "latest_developments", "seq")
    changed = diffing.changes(now, diffing.last_text(before, "key", F.col("latest_developments"), "seq"), "key", "latest_developments")
    changed = changed.limit(0) if prior is None else changed
    listed = diffing.catalog(stories.withColumn("gist", F.col("latest_developments")), changed)
    return changed, listed


def make_glance(stories: DataFrame, changed: DataFrame, listed: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """The list at the top: given trends (pos, text, topic_title, link_phrase), else none, and the changes."""
    spark = stories.sparkSession
    trends = spark.createDataFrame([], "pos int, text string, topic_title string, link_phrase string") if trends is None else trends
    topics = stories.filter("section_ord = 0")
    linked = diffing.link_titles(trends, topics, "topic_title", "title", "pos", "anchor").withColumn("run_id", F.lit("run"))
    updates = changed.select(F.lit("run").alias("run_id"), (F.col("section_ord") * 1000 + F.col("pos")).alias("pos"), "title", "anchor")
    return glance.glance(glance.plain_entries(linked, updates), listed.select(F.lit("run").alias("run_id"), "anchor", "title", "status"))


def extra_lines(extras: Extras, now: datetime) -> list[DataFrame]:
    """Lines of the payloads that there are."""
    at, run_id, out = lambda title: F.lit(PAGE.index(title)), F.lit("run").alias("run_id"), []
    if extras.forecast is not None:
        out.append(render.plain_lines(weather.weather_lines(extras.forecast).select(run_id, "pos", "line"), at("Weather"), "  ", "    "))
    if extras.boards is not None and extras.teams is not None:
        events = sports.events(extras.boards)
        blocks = sports.team_blocks(sports.games(events, extras.team), sports.next_game(events, F.lit(now)), extras.teams)
        out.append(render.team_lines(blocks.withColumn("run_id", run_id), at("Sports")))
    if extras.markets is not None:
        symbols = extras.markets.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(market.SYMBOLS)], "pos int, label string, symbol string, digits int")
        bars = market.closes(extras.markets, F.to_date(eastern(F.lit(now))))
        rows = market.market_rows(market.weekly_change(bars, "symbol", "ts", "close"), symbols)
        out.append(market.market_lines(rows).select(run_id, "pos", F.struct(F.col("pos").cast("long").alias("at"), F.lit(0).alias("n")).alias("ord"), "line").select("run_id", at(PAGE[-1]).alias("section"), "ord", "line"))
    return out


def _placed(stories: DataFrame) -> DataFrame:
    """Stories with their section's place on the page."""
    place = F.create_map(*(F.lit(x) for name, _ in SECTIONS for x in (name, PAGE.index(name))))
    return stories.withColumns({"run_id": F.lit("run"), "section": F.try_element_at(place, F.col("section"))})


def text_lines(stories: DataFrame, entries: DataFrame, *others: DataFrame) -> DataFrame:
    """The briefing as ordered lines; sections without lines aren't there."""
    rows = _placed(stories)
    topics = render.topic_lines(rows.filter("section_ord = 0").withColumn("rank", F.col("pos")), F.col("section"))
    local = render.story_lines(rows.filter("section_ord > 0"), F.col("section"))
    return render.briefing(PAGE, render.glance_lines(entries, F.lit(0)), topics, local, *others).orderBy("section", "ord")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, feed_rows: DataFrame, store: str, now: datetime, summarize: Summarizer = cluster, attempts: int = 2, extras: Extras = Extras(), retention: int = RETENTION_DAYS) -> DataFrame:
    """Make a briefing from feed rows, add it to the store and return its lines.

    A summarizer whose draft is unfit is asked again and told why, ``attempts`` times in all. The
    store keeps stories by day, the page of each run as text and HTML below ``_pages``, and a record
    of each run in ``_runs``; days of stories before the retention are deleted (0 keeps all).
    """
    store = store.rstrip("/")
    work = f"{store}/_work/{now:%Y%m%d%H%M%S}"  # Spark doesn't read names that begin so
    rows = _written(feed_rows, f"{work}/rows")
    items = _written(select_items(feed_items(rows), F.lit(now)), f"{work}/items")
    known = covered(spark, store, now)
    known = None if known is None else _written(known, f"{work}/memory")
    notes = Notes(memory=known)
    for left in reversed(range(attempts)):
        drafted = _written(summarize(items, notes).select(*STORY), f"{work}/drafted{left}")
        stories = _written(allowed_stories(drafted, items), f"{work}/stories{left}")
        try:
            check(feed_health(rows), drafted, stories, items)
            break
        except Unfit as e:
            if not left:
                raise
            notes = Notes(e.problems, known)
    prior = latest_stories(spark, store)
    prior = None if prior is None else _written(prior, f"{work}/prior")
    stories = _written(finish(stories.withColumn("anchor_key", F.concat_ws("#", "section", "pos")), items, now), f"{work}/finished")
    changed, listed = compare(stories, prior)
    entries = _written(make_glance(stories, changed, listed), f"{work}/glance")
    shown, page = extra_lines(extras, now), f"{store}/_pages/{now:%Y-%m-%d-%H%M%S}"
    stories.write.partitionBy("run_date").mode("append").parquet(store)
    archive.prune(spark, store, now.date(), retention)
    archive.save_page(text_lines(stories, entries, *shown), page)
    archive.save_page(render.page_html(f"Briefing of {now:%Y-%m-%d %H:%M}", PAGE, _placed(stories), entries, *shown), f"{page}.html")
    run_record(rows, items, stories, changed, now, attempts - left).write.mode("append").parquet(f"{store}/_runs")
    return text_lines(stories, entries, *shown)


def run_record(rows: DataFrame, items: DataFrame, stories: DataFrame, changed: DataFrame, now: datetime, asked: int) -> DataFrame:
    """One row on a run: feeds by group (group, loaded), and how many items, stories and changes there were."""
    health = feed_health(rows).agg(F.sort_array(F.collect_list(F.struct("group", F.col("loaded").cast("long").alias("loaded")))).alias("feeds"))
    changes = changed.agg(F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "updated").alias("updated"))
    counts = items.agg(F.count("*").alias("items")).crossJoin(stories.agg(F.count("*").alias("stories"))).crossJoin(changes)  # one row each
    return health.crossJoin(counts).withColumns({"run_ts": F.lit(now), "drafts": F.lit(asked)})


def _stored(spark: SparkSession, store: str, since: str | None = None) -> DataFrame | None:
    """Stories of the store; None if there are none yet."""
    try:
        return archive.load_runs(spark, store, since)
    except AnalysisException as e:  # nothing there yet, or only work files
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def covered(spark: SparkSession, store: str, now: datetime, days: int = MEMORY_DAYS) -> DataFrame | None:
    """(date, topics): Security's topics in the last run of each of the last days; None before the first run."""
    found = _stored(spark, store, f"{now - timedelta(days=days):%Y-%m-%d}")
    if found is None:
        return None
    last = found.groupBy("run_date").agg(F.max("run_ts").alias("run_ts"))
    topics = found.filter("section_ord = 0").join(last, ["run_date", "run_ts"]).withColumns({"date": F.to_date("run_date"), "last_24h": F.lit(None).cast("string")})
    return diffing.prior_topics(topics, F.lit(now.date()), days)


def latest_stories(spark: SparkSession, store: str) -> DataFrame | None:
    """Stories of the run before, which may be of the same day; None if there is none."""
    found = _stored(spark, store)
    if found is None:
        return None
    last = found.agg(F.max("run_ts")).first()[0]
    return None if last is None else found.filter(F.col("run_ts") == F.lit(last))
