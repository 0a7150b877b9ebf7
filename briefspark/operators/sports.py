"""Games of one team, from scoreboards and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions.dates import eastern, game_day, game_time
from briefspark.operators.selection import keep_first

_STATUS = "struct<type:struct<state:string,completed:boolean,shortDetail:string,detail:string>>"
_SIDE = "struct<homeAway:string,score:string,team:struct<abbreviation:string,shortDisplayName:string>>"
EVENT = f"struct<id:string,date:string,status:{_STATUS},competitions:array<struct<competitors:array<{_SIDE}>,headlines:array<struct<shortLinkText:string>>,status:{_STATUS}>>,season:struct<year:int,type:int>,seasonType:struct<type:int>,week:struct<number:int>>"
SCHEMA = f"events array<{EVENT}>"
# Names that pages use for teams where they aren't the abbreviation, and for playoff weeks.
SLUGS = {"mlb/CHW": "cws", "nhl/TB": "tbl", "nhl/NJ": "njd", "nhl/SJ": "sjs", "nhl/LA": "lak", "nfl/WSH": "was"}
PLAYOFFS = {1: "wild-card", 2: "divisional", 3: "conference", 5: "super-bowl"}
# Code points shown of each field.
LENGTHS = {"team": 80, "record": 20, "date": 40, "result": 160, "recap": 300, "matchup": 80, "when": 60}
PAGES = "https://plaintextsports.com"


def _lookup(key: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def shortened(rows: DataFrame) -> DataFrame:
    """Fields cut to what is shown of them."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in LENGTHS.items() if c in rows.columns})


def _instant(iso: Column) -> Column:
    """A timestamp whose seconds may be missing, as they are in these payloads; null if it isn't one."""
    return F.regexp_replace(iso, r"(T\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00").try_cast("timestamp")


def slug(league: Column, abbreviation: Column) -> Column:
    return F.coalesce(_lookup(F.concat(league, F.lit("/"), F.upper(abbreviation)), SLUGS), F.lower(abbreviation))


def nfl_week(event: Column) -> Column:
    """``year/week`` of an event, null if it can't be told."""
    year, kind, week = event["season"]["year"].cast("string"), F.coalesce(event["season"]["type"], event["seasonType"]["type"]), event["week"]["number"]
    name = F.when((kind == 1) & (week != 0), F.concat(F.lit("preseason-week"), week.cast("string"))).when((kind == 2) & (week != 0), F.concat(F.lit("week"), week.cast("string"))).when(kind == 3, _lookup(week, PLAYOFFS))
    return F.concat(F.nullif(year, F.lit("0")), F.lit("/"), name)


def game_url(league: Column, ts: Column, away: Column, home: Column, event: Column) -> Column:
    """NFL pages go by week, others by the local day."""
    pair = F.concat(slug(league, F.coalesce(away, F.lit(""))), F.lit("-"), slug(league, F.coalesce(home, F.lit(""))))
    by_week = F.coalesce(F.concat(F.lit(f"{PAGES}/nfl/"), nfl_week(event), F.lit("/"), pair), F.lit(f"{PAGES}/nfl/"))
    return F.when(league == "nfl", by_week).otherwise(F.concat(F.lit(f"{PAGES}/"), league, F.lit("/"), F.date_format(eastern(ts), "yyyy-MM-dd"), F.lit("/"), pair))


def events(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per event: league, board (order of the payloads), pos, e, ts, away and home (null unless there are two sides)."""
    rows = payloads.select("league", "board", F.posexplode(F.from_json(F.col(body), SCHEMA)["events"]).alias("pos", "e"))
    sides = F.get(F.col("e.competitions"), 0)["competitors"]
    side = lambda name, k: F.when(F.size(sides) == 2, F.coalesce(F.get(F.filter(sides, lambda c: c["homeAway"] == name), 0), F.get(sides, k)))
    return rows.withColumns({"away": side("away", 0), "home": side("home", 1), "ts": _instant(F.col("e.date"))})


def games(rows: DataFrame, team: str) -> DataFrame:
    """Games of ``team`` that have begun or ended, each event once (the first board's): date, result, url, recap."""
    played = rows.filter(F.col("away").isNotNull() & F.col("ts").isNotNull() & ((F.col("away.team.abbreviation") == team) | (F.col("home.team.abbreviation") == team)))
    status = F.col("e.status.type")
    state, detail = F.coalesce(status["state"], F.lit("")), F.coalesce(F.nullif(status["shortDetail"], F.lit("")), status["detail"], F.lit(""))
    played = keep_first(played.filter(state != "pre"), ["league", "e.id"], [F.col("board"), F.col("pos")])
    name = lambda s: F.coalesce(F.col(f"{s}.team.shortDisplayName"), F.lit("?"))
    scored = lambda s: F.concat(name(s), F.lit(" "), F.coalesce(F.col(f"{s}.score"), F.lit("?")))
    rest = F.regexp_replace(F.replace(detail, F.lit("Final"), F.lit("")), "^[/ ]+|[/ ]+$", "")
    shown = F.when(state == "post", F.concat(F.lit("Final"), F.when(rest != "", F.concat(F.lit(" ("), rest, F.lit(")"))).otherwise(""))).when(state == "in", F.trim(F.concat(detail, F.lit(" (in progress at last update)")))).otherwise(detail)
    off = (state == "post") & ~F.coalesce(status["completed"], F.lit(True))
    result = F.when(off, F.concat(name("away"), F.lit(" @ "), name("home"), F.lit(" · "), F.coalesce(F.nullif(detail, F.lit("")), F.lit("Postponed")))).otherwise(F.concat_ws(" · ", scored("away"), scored("home"), shown))
    recap = F.when(off, "").otherwise(F.coalesce(F.get(F.get(F.col("e.competitions"), 0)["headlines"], 0)["shortLinkText"], F.lit("")))
    url = game_url(F.col("league"), F.col("ts"), F.col("away.team.abbreviation"), F.col("home.team.abbreviation"), F.col("e"))
    shown_games = played.select("league", "board", "pos", game_day(F.col("ts")).alias("date"), result.alias("result"), url.alias("url"), recap.alias("recap"))
    return shortened(shown_games)


def next_game(rows: DataFrame, now: Column, days: int = 15) -> DataFrame:
    """Per league the earliest scheduled game after ``now`` and within ``days``; the first of equals."""
    state = F.get(F.col("e.competitions"), 0)["status"]["type"]["state"]
    ahead = rows.filter((F.coalesce(state, F.lit("")).isin("", "pre")) & (F.col("ts") > now) & (F.col("ts") <= now + F.make_dt_interval(days=F.lit(days))))
    found = ahead.groupBy("league").agg(F.min_by(F.struct("e", "ts", "away", "home"), F.struct("ts", "board", "pos")).alias("g")).select("league", "g.*").filter("away is not null")
    name = lambda s: F.coalesce(F.col(f"{s}.team.shortDisplayName"), F.lit("?"))
    ahead = found.select("league", F.concat(name("away"), F.lit(" @ "), name("home")).alias("matchup"), game_time(F.col("ts")).alias("when"), game_url(F.col("league"), F.col("ts"), F.col("away.team.abbreviation"), F.col("home.team.abbreviation"), F.col("e")).alias("url"))
    return shortened(ahead)


def team_blocks(played: DataFrame, ahead: DataFrame, teams: DataFrame) -> DataFrame:
    """Per league with a game or a next one: team, record, games in order, next."""
    ahead = ahead.withColumn("__next", F.struct("matchup", "when", "url")).select("league", "__next")
    each = played.groupBy("league").agg(F.sort_array(F.collect_list(F.struct("board", "pos", "date", "result", "url", "recap"))).alias("games"))
    return shortened(teams).join(each, "league", "left").join(ahead, "league", "left").filter("games is not null or __next is not null").withColumnRenamed("__next", "next")
