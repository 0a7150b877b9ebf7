"""The operators over the shared tables, each with the SQL that gives the same rows.

Streams of items are played by ``events``, topics and their sources by ``orders`` and
``lineitem``, texts by ``documents``, markup and URLs by ``pages``, earlier coverage by
``conversations``. The clock stands still.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.functions import dates, text
from briefspark.operators import archive, diffing, glance, market, profile, ranking, selection, sports, validation, weather
from briefspark.plans import render

NOW = "timestamp_ntz'2024-01-30 00:00:00'"
SQL_NOW = "TIMESTAMP '2024-01-30 00:00:00'"
DAY = "date'1998-01-01'"
ZONE = "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"


def _now():
    return F.expr(NOW)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recent_items_24h(spark, d):
    found = selection.recent_items(_t(spark, d, "events"), _now(), 24, 120, "event_type", "props", "ts", ("event_id",))
    return found.select("event_type", "event_id", "ts", "props", F.col("rank").cast("long").alias("rank"))


_KEY = r"regexp_replace(lower(props), '[^\p{L}\p{N}_]+', '', 'g')"
RECENT = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, {_KEY} ORDER BY ts DESC, event_id) AS rn FROM events
  WHERE ts BETWEEN {SQL_NOW} - INTERVAL 24 HOUR AND {SQL_NOW} + INTERVAL 2 HOUR),
k AS (SELECT event_type, event_id, ts, props, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM r WHERE rn = 1)
SELECT * FROM k WHERE rank <= 120"""


def adaptive_window(spark, d):
    found = selection.adaptive_window(_t(spark, d, "events"), _now(), 24, 48, 5, 120, "user_id", "props", "ts", ("event_id",))
    return found.select("user_id", F.col("window_hours").cast("long").alias("window_hours"), "event_id", "ts", F.col("rank").cast("long").alias("rank"))


ADAPTIVE = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, {_KEY} ORDER BY ts DESC, event_id) AS rn FROM events
  WHERE ts BETWEEN {SQL_NOW} - INTERVAL 48 HOUR AND {SQL_NOW} + INTERVAL 2 HOUR),
u AS (SELECT *, ts >= {SQL_NOW} - INTERVAL 24 HOUR AS inside FROM r WHERE rn = 1),
h AS (SELECT user_id, CASE WHEN least(count_if(inside), 120) < 5 THEN 48 ELSE 24 END::BIGINT AS window_hours FROM u GROUP BY user_id),
k AS (SELECT u.user_id, window_hours, event_id, ts, row_number() OVER (PARTITION BY u.user_id ORDER BY ts DESC, event_id) AS rank
  FROM u JOIN h USING (user_id) WHERE window_hours = 48 OR inside)
SELECT * FROM k WHERE rank <= 120"""


def topk_per_group(spark, d):
    found = selection.newest_per_group(_t(spark, d, "events"), ["event_type"], [F.col("ts").desc(), F.col("event_id")], 3)
    return found.select("event_type", "event_id", "ts", F.col("rank").cast("long").alias("rank"))


TOPK = "SELECT * FROM (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 3"


def title_key_dedupe(spark, d):
    keyed = _t(spark, d, "documents").select("doc_id", F.sha2(text.title_key(F.coalesce("text", F.lit(""))), 256).alias("key_sha256"))
    return selection.keep_first(keyed, ["key_sha256"], [F.col("doc_id")])


TITLE_KEY = r"SELECT min(doc_id) AS doc_id, sha256(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', '', 'g')) AS key_sha256 FROM documents GROUP BY 2"


def clean_text(spark, d):
    return _t(spark, d, "pages").select("page_id", text.clean_html(F.col("html"), 480).alias("cleaned"))


_TAGS = r"'</?[A-Za-z][^>]*>|<!--.*?-->', ' ', 'gs'"
_SPACES = r"'[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'"
CLEAN = f"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), {_TAGS}) AS t FROM pages),
b AS (SELECT page_id, regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, {_TAGS}), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), {_SPACES})) AS t FROM b)
SELECT page_id, CASE WHEN length(t) > 480 THEN regexp_replace(substr(t, 1, 477), ' [^ ]*$', '') || '...' ELSE t END AS cleaned FROM c"""


def truncate_summary(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.truncate_words(F.col("text"), 480).alias("summary"))


TRUNCATE = r"SELECT doc_id, CASE WHEN length(text) > 480 THEN regexp_replace(substr(text, 1, 477), ' [^ ]*\z', '') || '...' ELSE text END AS summary FROM documents"


def corpus_projection(spark, d):
    items = _t(spark, d, "events").select(F.col("event_type").alias("source"), F.col("props").alias("title"), F.col("event_id").cast("string").alias("url"), F.col("ts").alias("published"), F.lit("").alias("summary"))
    return selection.corpus(items)


CORPUS = "SELECT event_type AS source, props AS title, event_id::VARCHAR AS url, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS published, '' AS summary FROM events"


def url_anchor(spark, d):
    return _t(spark, d, "pages").select("page_id", text.norm_url(F.col("url")).alias("norm_url"), text.anchor(F.col("url")).alias("anchor"))


URL_ANCHOR = "SELECT page_id, lower(trim(coalesce(url, ''))) AS norm_url, CASE WHEN coalesce(url, '') <> '' THEN 'i-' || substr(sha1(lower(trim(url))), 1, 10) END AS anchor FROM pages"


def anchor_collisions(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", text.anchor(F.col("role")).alias("base"))
    return ranking.unique_anchors(rows, "base", ["turn"], ("conv_id",)).select("conv_id", "turn", "anchor")


COLLISIONS = """
WITH b AS (SELECT conv_id, turn, 'i-' || substr(sha1(lower(trim(role))), 1, 10) AS base FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, base ORDER BY turn) AS n FROM b)
SELECT conv_id, turn, CASE WHEN n = 1 THEN base ELSE base || '-' || n::VARCHAR END AS anchor FROM n"""


def published_index(spark, d):
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return ranking.oldest_by_key(_t(spark, d, "pages"), host, "page_id", "host")


PUBLISHED = "SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, min(page_id) AS page_id FROM pages GROUP BY 1 HAVING host <> ''"


def topic_recency(spark, d):
    topics = _t(spark, d, "orders").select("o_orderkey")
    sources = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return ranking.newest_of_sources(topics, sources, "o_orderkey", "l_shipdate")


RECENCY = "SELECT o_orderkey, max(l_shipdate) AS recency, count(l_orderkey) AS n_sources FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


def order_topics(spark, d):
    topics = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    sources = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    found = ranking.newest_of_sources(topics, sources, "o_orderkey", "l_shipdate")
    return ranking.topic_rank(found, ["o_custkey"], "recency", "n_sources", F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


ORDER = f"""
WITH r AS (SELECT o.o_custkey, t.* FROM ({RECENCY}) t JOIN orders o USING (o_orderkey))
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY recency::DATE DESC NULLS LAST, n_sources DESC, o_orderkey) AS rank FROM r"""


def area_first_appearance(spark, d):
    found = ranking.by_first_appearance(_t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return found.select("o_custkey", "o_orderkey", "area_pos", F.col("pos").cast("long").alias("pos"))


AREAS = """
WITH a AS (SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS area_pos FROM orders)
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY area_pos, o_orderkey) AS pos FROM a"""


def _small_parts(spark, d):
    return _t(spark, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))


def citation_allowlist(spark, d):
    return validation.cited(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), _small_parts(spark, d), ["l_partkey"])


CITED = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)"


def section_allowlist(spark, d):
    sections = spark.createDataFrame([("R", "ECONOMY"), ("A", "ECONOMY"), ("A", "PROMO"), ("N", "LARGE"), ("N", "LARGE")], "l_returnflag string, p_type string")
    allowed = validation.section_allowed(_t(spark, d, "part").select("p_type", F.col("p_partkey").alias("l_partkey")), sections, "p_type", "l_returnflag", "l_partkey")
    return validation.cited(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"), allowed, ["l_returnflag", "l_partkey"])


SECTION = """
SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE (l_returnflag, p_type) IN (('R', 'ECONOMY'), ('A', 'ECONOMY'), ('A', 'PROMO'), ('N', 'LARGE'))"""


def uncited_dropped(spark, d):
    citations = citation_allowlist(spark, d).select(F.col("l_orderkey").alias("o_orderkey"))
    return validation.without_citation(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), citations, "o_orderkey")


UNCITED = f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM ({CITED}))"


def rule_problems(spark, d):
    rules = {
        "missing text": ~validation.filled(F.col("text")),
        "missing source": ~validation.filled(F.col("source")),
        "short": F.coalesce(F.col("n_chars"), F.lit(0)) < 100,
        "unknown language": ~F.coalesce(F.col("lang"), F.lit("")).isin("en", "de"),
    }
    return validation.problems(_t(spark, d, "documents"), "doc_id", rules)


RULE_PROBLEMS = """
SELECT doc_id, 'missing text' AS problem FROM documents WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT doc_id, 'missing source' FROM documents WHERE trim(coalesce(source, '')) = ''
UNION ALL SELECT doc_id, 'short' FROM documents WHERE coalesce(n_chars, 0) < 100
UNION ALL SELECT doc_id, 'unknown language' FROM documents WHERE coalesce(lang, '') NOT IN ('en', 'de')"""

# Drafts: each customer's orders are the topics of a run; some lack parts, and those that five divides lack a source.
TOPICS = """SELECT o_custkey AS run_id, o_orderkey AS pos, o_orderpriority AS section, CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' || o_orderpriority END AS title,
  nullif(o_orderstatus, 'P') AS latest_developments, CASE WHEN o_totalprice < 50000 THEN '' ELSE o_orderstatus END AS summary FROM orders"""


def _drafts(spark, d):
    topics = spark.sql(TOPICS.replace("FROM orders", "FROM {orders}"), orders=_t(spark, d, "orders"))
    return topics, topics.filter("pos % 5 <> 0")


def digest_problems(spark, d):
    topics, citations = _drafts(spark, d)
    heads = _t(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("headline"))
    trends = topics.select("run_id", F.nullif("latest_developments", F.lit("F")).alias("text"))
    return validation.digest_problems(topics, trends, F.col("headline"), heads, citations)


PROBLEMS = f"""
WITH t AS ({TOPICS}),
p AS (SELECT run_id, pos, unnest(['title', 'latest_developments', 'summary']) AS part, unnest([title, latest_developments, summary]) AS value FROM t),
c AS (SELECT c_custkey AS run_id, nullif(c_mktsegment, 'BUILDING') AS headline FROM customer)
SELECT run_id, 'topic ' || pos::VARCHAR || ': missing ' || part AS problem FROM p WHERE trim(coalesce(value, '')) = ''
UNION ALL SELECT run_id, 'topic ' || pos::VARCHAR || ': no valid sources' FROM t WHERE pos % 5 = 0
UNION ALL SELECT run_id, 'missing headline' FROM c WHERE headline IS NULL
UNION ALL SELECT run_id, 'missing topics' FROM c WHERE run_id NOT IN (SELECT run_id FROM t)
UNION ALL SELECT run_id, 'trends need text' FROM c WHERE run_id NOT IN (SELECT run_id FROM t GROUP BY run_id HAVING bool_and(coalesce(latest_developments, 'F') <> 'F'))"""


def local_items(spark, d):
    topics, citations = _drafts(spark, d)
    return validation.local_items(topics, citations).select("section", "pos", "title", "latest_developments", "summary")


LOCAL = f"""
SELECT section, pos, trim(title) AS title, latest_developments, summary FROM ({TOPICS}) WHERE pos % 5 <> 0 AND trim(title) <> '' AND latest_developments IS NOT NULL"""


def _last_event(spark, d, day):
    found = _t(spark, d, "events").filter(F.to_date("ts") == F.lit(day).cast("date"))
    return found.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("text"))


def run_diff(spark, d):
    before = _t(spark, d, "events").filter(F.to_date("ts") == F.lit("2024-01-29").cast("date")).select(F.col("user_id").cast("string").alias("key"), "event_type", "ts")
    prior = diffing.last_text(before, "key", F.col("event_type"), "ts")
    return diffing.changes(_last_event(spark, d, "2024-01-30"), prior, "key", "text").select("key", "status", "new_text", "old_text")


def _last_sql(day):
    return f"SELECT user_id::VARCHAR AS key, arg_max(event_type, ts) AS t FROM events WHERE ts::DATE = DATE '{day}' GROUP BY user_id"


DIFF = f"""
WITH c AS ({_last_sql("2024-01-30")}), p AS ({_last_sql("2024-01-29")})
SELECT c.key, CASE WHEN p.key IS NULL THEN 'new' ELSE 'updated' END AS status, c.t AS new_text, lower(p.t) AS old_text
FROM c LEFT JOIN p ON c.key = p.key WHERE p.key IS NULL OR lower(c.t) <> lower(p.t)"""


def catalog_status(spark, d):
    part = lambda day: _last_event(spark, d, day).select(F.col("key").alias("anchor"), F.col("text").alias("gist"))
    stories = diffing.stacked([(s, part(day)) for s, day in (("Security", "2024-01-30"), ("Business", "2024-01-29"), ("Reading", "2024-01-28"))])
    changed = run_diff(spark, d).select(F.col("key").alias("anchor"), "status")
    return diffing.catalog(stories, changed).select("section", F.col("section_ord").cast("long").alias("section_ord"), "anchor", "gist", "status")


CATALOG = f"""
WITH s AS (SELECT 'Security' AS section, 0::BIGINT AS section_ord, key, t FROM ({_last_sql("2024-01-30")})
  UNION ALL SELECT 'Business', 1, key, t FROM ({_last_sql("2024-01-29")}) UNION ALL SELECT 'Reading', 2, key, t FROM ({_last_sql("2024-01-28")}))
SELECT section, section_ord, s.key AS anchor, t AS gist, coalesce(status, 'unchanged') AS status FROM s LEFT JOIN ({DIFF}) x ON s.key = x.key"""


def trend_to_topic(spark, d):
    part = _t(spark, d, "part")
    trends = part.filter("p_size <= 5").select(F.col("p_partkey").alias("trend"), F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit("  ")))).alias("topic_title"))
    topics = part.filter("p_size > 30").select(F.col("p_partkey").alias("pos"), "p_name", text.anchor(F.col("p_partkey").cast("string")).alias("anchor"))
    return diffing.link_titles(trends, topics, "topic_title", "p_name", "pos", "anchor")


TREND = """
WITH f AS (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_size > 30 GROUP BY p_name)
SELECT p.p_partkey AS trend, ' ' || upper(replace(p.p_name, ' ', '  ')) AS topic_title, CASE WHEN k IS NOT NULL THEN 'i-' || substr(sha1(k::VARCHAR), 1, 10) END AS linked
FROM part p LEFT JOIN f ON p.p_name = f.p_name WHERE p.p_size <= 5"""


def seen_url_append(spark, d):
    events = _t(spark, d, "events")
    today = F.lit("2024-01-30").cast("date")
    found = profile.unseen(events.filter(F.col("ts") >= today), events.filter(F.col("ts") < today), ["user_id", "props"], [F.col("ts"), F.col("event_id")])
    return found.select("user_id", "props", "event_id", "ts")


SEEN = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS rn FROM events WHERE ts >= DATE '2024-01-30')
SELECT user_id, props, event_id, ts FROM n WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM events s WHERE s.user_id = n.user_id AND s.props = n.props AND s.ts < DATE '2024-01-30')"""


def _local_events(spark, d):
    local = dates.eastern(F.col("ts"))
    return _t(spark, d, "events").select("event_type", F.hour(local).alias("hour"), F.date_format(local, "EEEE").alias("weekday"))


def hour_histogram_et(spark, d):
    return profile.hour_histogram(_local_events(spark, d), "hour")


HISTOGRAM = f"""
WITH c AS (SELECT hour({ZONE})::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1),
a AS (SELECT h.hour::INTEGER AS hour, coalesce(n, 0)::BIGINT AS n FROM range(24) h(hour) LEFT JOIN c USING (hour))
SELECT hour, n, CASE WHEN n > 0 THEN repeat('#', greatest(1, round_even(40.0 * n / (SELECT max(n) FROM a), 0))::BIGINT) ELSE '' END AS bar FROM a"""


def block_share(spark, d):
    return profile.block_share(_local_events(spark, d), "event_type", "hour")


_BLOCKS = ", ".join(f"round_even(100.0 * count_if(hour BETWEEN {4 * b} AND {4 * b + 3}) / count(*), 0)::DOUBLE AS h{4 * b:02d}_{4 * b + 4:02d}" for b in range(6))
BLOCKS = f"""
WITH e AS (SELECT event_type, hour({ZONE}) AS hour FROM events)
SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type, {_BLOCKS}, count(*) AS n FROM e GROUP BY ROLLUP (event_type)"""


def weekday_weekend(spark, d):
    return profile.weekday_split(_local_events(spark, d), "event_type", "weekday")


WEEKDAY = f"""
WITH e AS (SELECT event_type, isodow({ZONE}) AS w FROM events)
SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type, count_if(w < 6)::BIGINT AS weekday, count_if(w > 5)::BIGINT AS weekend FROM e GROUP BY ROLLUP (event_type)"""


def freshness_lag(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    joined = _t(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return profile.lag_report(joined, "o_orderpriority", "o_orderdate", "l_shipdate")


LAG = """
WITH l AS (SELECT o_orderpriority, date_diff('second', o_orderdate, l_shipdate) / 3600.0 AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT * FROM l UNION ALL SELECT 'ALL', lag FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY lag) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM a)
SELECT o_orderpriority, median(lag)::DOUBLE AS median_hours, max(CASE WHEN k = least(n, greatest(1, round_even(0.9 * n, 0))) THEN lag END)::DOUBLE AS p90_hours, max(n) AS n FROM k GROUP BY o_orderpriority"""


def date_span(spark, d):
    return profile.date_span(_t(spark, d, "events"), "ts")


SPAN = "SELECT min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, date_diff('microsecond', min(ts), max(ts)) / 3.6e9 / 24 AS span_days, count(*) AS n FROM events"


def weekly_average(spark, d):
    daily = _t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    found = market.weekly_change(daily, "event_type", "day", "value")
    return found.select("event_type", F.round("current", 6).alias("current"), F.round("previous", 6).alias("previous"), F.round("pct", 6).alias("pct"), text.thousands(F.col("current"), 2).alias("value"), text.arrow(F.col("pct")).alias("arrow"))


WEEKLY = """
WITH d AS (SELECT event_type, ts::DATE AS day, arg_max(value, ts) AS v FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d),
m AS (SELECT event_type, avg(v) FILTER (k <= 5) AS c, avg(v) FILTER (k BETWEEN 6 AND 10) AS p FROM k GROUP BY 1 HAVING count(*) >= 10),
x AS (SELECT *, (c - p) / p * 100 AS pct FROM m)
SELECT event_type, round(c, 6) AS current, round(p, 6) AS previous, round(pct, 6) AS pct, format('{:,.2f}', c) AS value, CASE WHEN abs(pct) < 0.05 THEN '=' WHEN pct > 0 THEN '▲' ELSE '▼' END AS arrow FROM x"""


def _boards(spark, d):
    """Scoreboards of one event each, from orders: the clerk's state is the game's, customers are the home sides."""
    o = _t(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "pre").when(F.col("o_orderstatus") == "F", "post").otherwise("in")
    detail = F.when(state == "in", "Top 3").when(F.col("o_orderkey") % 3 == 0, "Final/10").otherwise("Final")
    status = F.struct(F.struct(state.alias("state"), (F.col("o_totalprice") > 30000).alias("completed"), detail.alias("shortDetail")).alias("type"))
    side = lambda which, letter, key: F.struct(F.lit(which).alias("homeAway"), (key % 9).cast("string").alias("score"), F.struct(F.concat(F.lit(letter), (key % 10).cast("string")).alias("abbreviation"), F.concat(F.lit(f"{letter}-"), key.cast("string")).alias("shortDisplayName")).alias("team"))
    game = F.struct(F.array(side("home", "H", F.col("o_custkey")), side("away", "A", F.col("o_orderkey"))).alias("competitors"), F.array(F.struct(F.lit("recap").alias("shortLinkText"))).alias("headlines"), status.alias("status"))
    event = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), status.alias("status"), F.array(game).alias("competitions"),
        F.struct(F.year("o_orderdate").alias("year"), F.lit(2).alias("type")).alias("season"), F.struct(F.month("o_orderdate").alias("number")).alias("week"),
    )
    league = F.when(F.col("o_custkey") % 4 == 0, "nfl").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return sports.events(o.select(league.alias("league"), F.col("o_orderkey").alias("board"), F.to_json(F.struct(F.array(event).alias("events"))).alias("body")))


_GAMES = """
WITH g AS (SELECT *, CASE WHEN o_custkey % 4 = 0 THEN 'nfl' ELSE 'c' || o_custkey::VARCHAR END AS league, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et,
    'A-' || o_orderkey::VARCHAR AS away, 'H-' || o_custkey::VARCHAR AS home, 'a' || (o_orderkey % 10)::VARCHAR || '-h' || (o_custkey % 10)::VARCHAR AS pair FROM orders),
u AS (SELECT *, 'https://plaintextsports.com/' || league || '/' || CASE WHEN league = 'nfl' THEN year(o_orderdate)::VARCHAR || '/week' || month(o_orderdate)::VARCHAR ELSE strftime(et, '%Y-%m-%d') END || '/' || pair AS url FROM g)"""


def team_games(spark, d):
    return sports.games(_boards(spark, d), "H3").select("league", "board", "date", "result", "url", "recap")


GAMES = f"""{_GAMES},
s AS (SELECT *, away || ' ' || (o_orderkey % 9)::VARCHAR || ' · ' || home || ' ' || (o_custkey % 9)::VARCHAR || ' · ' AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'Final/10' ELSE 'Final' END AS detail FROM u)
SELECT league, o_orderkey AS board, strftime(et, '%a %b %-d') AS date, CASE WHEN o_orderstatus = 'P' THEN score || 'Top 3 (in progress at last update)'
    WHEN o_totalprice <= 30000 THEN away || ' @ ' || home || ' · ' || detail ELSE score || CASE WHEN o_orderkey % 3 = 0 THEN 'Final (10)' ELSE 'Final' END END AS result,
  url, CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 30000 THEN '' ELSE 'recap' END AS recap
FROM s WHERE o_orderstatus <> 'O' AND o_custkey % 10 = 3"""


def next_game(spark, d):
    return sports.next_game(_boards(spark, d), F.expr(DAY).cast("timestamp"))


NEXT = f"""{_GAMES},
k AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY o_orderdate, o_orderkey) AS k FROM u
  WHERE o_orderstatus = 'O' AND o_orderdate > DATE '1998-01-01' AND o_orderdate <= DATE '1998-01-16')
SELECT league, away || ' @ ' || home AS matchup, strftime(et, '%a %b %-d, %-I:%M %p') AS "when", url FROM k WHERE k = 1"""


def market_table(spark, d):
    """Charts of each event type's last value a day, the running day's bar left out, as aligned lines."""
    daily = _t(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.max_by("value", "ts").alias("close"))
    bars = F.sort_array(F.collect_list(F.struct(F.unix_timestamp(F.col("day").cast("timestamp")).alias("ts"), "close")))  # a bar a day
    charts = daily.groupBy("symbol").agg(bars.alias("b"))
    quote = F.struct(F.array(F.struct(F.transform("b", lambda x: x["close"]).alias("close"))).alias("quote"))
    result = F.struct(F.transform("b", lambda x: x["ts"]).alias("timestamp"), quote.alias("indicators"))
    payloads = charts.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("body"))
    changes = market.weekly_change(market.closes(payloads, F.to_date(_now())), "symbol", "ts", "close")
    symbols = charts.select(F.length("symbol").cast("long").alias("pos"), F.upper("symbol").alias("label"), "symbol", F.when(F.col("symbol") < "m", 4).otherwise(2).alias("digits"))
    return market.market_lines(market.market_rows(changes, symbols))


MARKET = f"""
WITH d AS (SELECT event_type, ts::DATE AS day, arg_max(value, ts) AS v FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d WHERE day < {SQL_NOW}::DATE),
m AS (SELECT event_type, avg(v) FILTER (k <= 5) AS c, avg(v) FILTER (k BETWEEN 6 AND 10) AS p FROM k GROUP BY 1 HAVING count(*) >= 10),
x AS (SELECT *, (c - p) / p * 100 AS pct, CASE WHEN event_type < 'm' THEN format('{{:,.4f}}', c) ELSE format('{{:,.2f}}', c) END AS shown FROM m)
SELECT length(event_type) AS pos, rpad(upper(event_type), (SELECT max(length(event_type)) FROM x)::INTEGER, ' ') || '  ' || lpad(shown, (SELECT max(length(shown)) FROM x)::INTEGER, ' ') || '  ' ||
  CASE WHEN abs(pct) < 0.05 THEN '=' WHEN pct > 0 THEN '▲' ELSE '▼' END || ' ' || CASE WHEN pct < 0 THEN '-' ELSE '+' END || format('{{:,.1f}}', abs(pct)) || '%' AS line FROM x"""


def feed_dates(spark, d):
    """Dates in five forms, read back."""
    ts, k = F.col("ts"), F.col("event_id") % 5
    mail = lambda t, zone: F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(f" {zone}"))
    shown = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, mail(ts, "GMT")).when(k == 2, mail(ts - F.expr("interval 5 hours"), "-0500")).when(k == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return _t(spark, d, "events").select("event_id", F.date_format(dates.parse_date(shown), "yyyy-MM-dd HH:mm:ss").alias("published"))


FEED_DATES = "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published FROM events"


def plain_glance(spark, d):
    part = _t(spark, d, "part")
    linked = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("i-"), F.col("p_partkey").cast("string")))
    trends = part.filter("p_size <= 25").select(F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"), linked.alias("linked"), F.col("p_type").alias("link_phrase"))
    changed = part.filter("p_size > 25").select(F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.concat(F.lit("i-"), F.col("p_partkey").cast("string")).alias("anchor"))
    link = F.get("links", 0)
    return glance.plain_entries(trends, changed).select("run_id", "pos", "kind", "text", link["anchor"].alias("anchor"), link["phrase"].alias("phrase"))


PLAIN = """
SELECT p_brand AS run_id, p_partkey AS pos, 'Trend' AS kind, p_name AS text, CASE WHEN p_partkey % 3 <> 0 THEN 'i-' || p_partkey::VARCHAR END AS anchor, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS phrase FROM part WHERE p_size <= 25
UNION ALL SELECT p_brand, p_partkey + (1::BIGINT << 40), 'Update', p_name, 'i-' || p_partkey::VARCHAR, p_name FROM part WHERE p_size > 25"""


def last_runs(spark, d):
    runs = _t(spark, d, "events").select(F.to_date("ts").alias("run_date"), F.col("ts").alias("run_ts"), "event_id", "event_type")
    return archive.last_of_day(runs).withColumn("latest", F.col("event_id") == F.lit(archive.latest_run(runs).first()["event_id"]))


LAST_RUNS = """
SELECT ts::DATE AS run_date, max(ts) AS run_ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, max(ts) = (SELECT max(ts) FROM events) AS latest FROM events GROUP BY 1"""


def prior_total(spark, d):
    rows = _t(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("event_id").alias("pos"), F.col("event_type").alias("title"), *(F.lit("").alias(c) for c in ("area", "latest_developments", "last_24h")), F.col("props").alias("summary"))
    return archive.prior_count(diffing.prior_topics(rows, F.to_date(_now()), 7))


PRIOR_TOTAL = f"SELECT count(DISTINCT ts::DATE) AS runs, count(*) AS topics FROM events WHERE ts::DATE >= {SQL_NOW}::DATE - 7"


def first_periods(spark, d):
    """Conversations as forecasts: a period for each of the first five turns, of which three are shown."""
    turns = selection.newest_per_group(_t(spark, d, "conversations"), ["conv_id"], [F.col("turn")], 5)
    period = F.struct(F.col("role").alias("name"), F.col("text").alias("shortForecast"), (F.col("role") == "user").alias("isDaytime"), F.col("turn").cast("int").alias("temperature"), F.lit("F").alias("temperatureUnit"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", period.alias("p")))), lambda x: x["p"])
    payloads = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(listed.alias("periods")).alias("properties"))).alias("body"))
    return weather.weather_lines(payloads, keys=["conv_id"]).select("conv_id", F.col("pos").cast("long").alias("pos"), "line")


PERIODS = """
SELECT conv_id, pos, substr(role || ': ' || text || ', ' || CASE WHEN role = 'user' THEN 'high' ELSE 'low' END || ' ' || turn::VARCHAR || 'F.', 1, 200) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) WHERE pos < 3"""


def prior_coverage(spark, d):
    rows = _t(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("event_id").alias("pos"), F.col("event_type").alias("title"), F.lit("").alias("area"), F.lit("").alias("latest_developments"), F.lit(None).cast("string").alias("last_24h"), F.col("props").alias("summary"))
    found = diffing.prior_topics(rows, F.to_date(_now()), 7)
    lines = F.transform("topics", lambda t: F.concat(t["title"], F.lit("="), t["development"]))
    return found.select("date", F.size("topics").cast("long").alias("n"), F.sha2(F.array_join(lines, "|"), 256).alias("topics_sha256"))


COVERAGE = f"""
SELECT ts::DATE AS date, count(*) AS n, sha256(string_agg(event_type || '=' || props, '|' ORDER BY event_id)) AS topics_sha256
FROM events WHERE ts::DATE >= {SQL_NOW}::DATE - 7 GROUP BY 1"""


def history_lines(spark, d):
    line = diffing.history_line(F.col("role"), F.col("text"))
    found = diffing.history(_t(spark, d, "conversations"), "conv_id", "role", ["turn"], line, ["user", "assistant"])
    return found.select("conv_id", *(F.sha2(F.array_join(c, "|"), 256).alias(c) for c in ("user", "assistant")))


_LINES = "sha256(coalesce(string_agg(line, '|' ORDER BY turn) FILTER (role = '{0}'), '')) AS {0}"
HISTORY = f"""
WITH l AS (SELECT conv_id, turn, role, concat_ws(' — ', nullif(trim(coalesce(role, '')), ''), nullif(trim(coalesce(text, '')), '')) AS line FROM conversations)
SELECT conv_id, {_LINES.format("user")}, {_LINES.format("assistant")} FROM l WHERE line <> '' GROUP BY conv_id"""


def archive_index(spark, d):
    stems = _t(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd-HHmm").alias("stem")).distinct()
    stems = stems.union(spark.createDataFrame([("2024-01-01",), ("index",), ("junk",)], "stem string"))
    found = archive.stem_index(stems)
    return found.select("day", F.size("runs").cast("long").alias("n"), F.array_join(F.transform("runs", lambda r: r["label"]), ",").alias("labels"))


INDEX = """
WITH s AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS label, strftime(ts, '%Y-%m-%d-%H%M') AS stem FROM events UNION ALL SELECT '2024-01-01', 'briefing', '2024-01-01')
SELECT day, count(*) AS n, string_agg(label, ',' ORDER BY stem DESC) AS labels FROM s GROUP BY day"""


def retention_prune(spark, d):
    gone = archive.expired(_t(spark, d, "orders"), F.to_date("o_orderdate"), F.expr(DAY), 90)
    return gone.select("o_orderkey", F.to_date("o_orderdate").alias("run_date"))


PRUNE = "SELECT o_orderkey, o_orderdate::DATE AS run_date FROM orders WHERE o_orderdate::DATE < DATE '1998-01-01' - 90"


def long_dates(spark, d):
    days = _t(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("iso")).distinct()
    return days.select("iso", dates.long_date(F.col("iso")).alias("shown"))


LONG_DATES = "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS iso, strftime(o_orderdate, '%A, %B %-d, %Y') AS shown FROM orders"


def escaped_links(spark, d):
    pages = _t(spark, d, "pages")
    escaped = text.escape_html(F.col("html"))
    return pages.select("page_id", text.safe_url(F.col("url")).alias("href"), F.length(escaped).cast("long").alias("n_escaped"), F.sha2(escaped, 256).alias("escaped_sha256"))


def _escaped_sql(c):
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{plain}', '{code}')"
    return c


ESCAPED = f"""
WITH e AS (SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN {_escaped_sql("url")} ELSE '#' END AS href, {_escaped_sql("html")} AS escaped FROM pages)
SELECT page_id, href, length(escaped)::BIGINT AS n_escaped, sha256(escaped) AS escaped_sha256 FROM e"""


def json_in_prose(spark, d):
    found = text.json_object(F.col("html"))
    return _t(spark, d, "pages").select("page_id", F.length(found).cast("long").alias("n_chars"), F.sha2(found, 256).alias("json_sha256"))


JSON_IN_PROSE = r"""
WITH j AS (SELECT page_id, nullif(regexp_extract(html, '(?s)\{.*\}'), '') AS j FROM pages)
SELECT page_id, length(j)::BIGINT AS n_chars, sha256(j) AS json_sha256 FROM j"""


def linked_names(spark, d):
    """Names of parts with a link on the first word, one that overlaps it, which is skipped, and one on the last character."""
    name = F.col("p_name")
    first, last = F.instr(name, " ") - 1, F.length(name)
    link = lambda anchor, a, b: F.struct(anchor.alias("anchor"), F.lit("").alias("phrase"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit("").alias("title"))
    links = F.array(link(F.concat(F.lit("i-"), F.col("p_partkey").cast("string")), F.lit(0), first), link(F.lit("over"), F.lit(1), first + 1), link(F.lit("a&b"), last - 1, last))
    return _t(spark, d, "part").select("p_partkey", render.linked_html(name, links).alias("html"))


LINKED = """
WITH p AS (SELECT p_partkey, p_name, instr(p_name, ' ') - 1 AS f, length(p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN f > 0 THEN '<a href="#i-' || p_partkey::VARCHAR || '">' || substr(p_name, 1, f) || '</a>' || substr(p_name, f + 1, n - f - 1)
  ELSE substr(p_name, 1, n - 1) END || '<a href="#a&amp;b">' || substr(p_name, n, 1) || '</a>' AS html FROM p"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "recent_items_24h": (recent_items_24h, RECENT),
    "adaptive_window": (adaptive_window, ADAPTIVE),
    "topk_per_group": (topk_per_group, TOPK),
    "title_key_dedupe": (title_key_dedupe, TITLE_KEY),
    "clean_text": (clean_text, CLEAN),
    "truncate_summary": (truncate_summary, TRUNCATE),
    "corpus_projection": (corpus_projection, CORPUS),
    "url_anchor": (url_anchor, URL_ANCHOR),
    "anchor_collisions": (anchor_collisions, COLLISIONS),
    "published_index": (published_index, PUBLISHED),
    "topic_recency": (topic_recency, RECENCY),
    "order_topics": (order_topics, ORDER),
    "area_first_appearance": (area_first_appearance, AREAS),
    "citation_allowlist": (citation_allowlist, CITED),
    "section_allowlist": (section_allowlist, SECTION),
    "uncited_dropped": (uncited_dropped, UNCITED),
    "rule_problems": (rule_problems, RULE_PROBLEMS),
    "digest_problems": (digest_problems, PROBLEMS),
    "local_items": (local_items, LOCAL),
    "run_diff": (run_diff, DIFF),
    "catalog_status": (catalog_status, CATALOG),
    "trend_to_topic": (trend_to_topic, TREND),
    "seen_url_append": (seen_url_append, SEEN),
    "hour_histogram_et": (hour_histogram_et, HISTOGRAM),
    "block_share": (block_share, BLOCKS),
    "weekday_weekend": (weekday_weekend, WEEKDAY),
    "freshness_lag": (freshness_lag, LAG),
    "date_span": (date_span, SPAN),
    "weekly_average": (weekly_average, WEEKLY),
    "market_table": (market_table, MARKET),
    "team_games": (team_games, GAMES),
    "next_game": (next_game, NEXT),
    "feed_dates": (feed_dates, FEED_DATES),
    "plain_glance": (plain_glance, PLAIN),
    "last_runs": (last_runs, LAST_RUNS),
    "prior_total": (prior_total, PRIOR_TOTAL),
    "first_periods": (first_periods, PERIODS),
    "prior_coverage": (prior_coverage, COVERAGE),
    "history_lines": (history_lines, HISTORY),
    "archive_index": (archive_index, INDEX),
    "retention_prune": (retention_prune, PRUNE),
    "long_dates": (long_dates, LONG_DATES),
    "escaped_links": (escaped_links, ESCAPED),
    "json_in_prose": (json_in_prose, JSON_IN_PROSE),
    "linked_names": (linked_names, LINKED),
}
