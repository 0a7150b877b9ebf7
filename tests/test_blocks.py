import json
from datetime import datetime

from pyspark.sql import functions as F

from briefspark.operators import glance, market, sports, weather
from briefspark.plans import render
from briefspark.streaming import seen


def event(ident, date, state, away=("NYY", "Yankees", "3"), home=("PIT", "Pirates", "5"), detail="Final", completed=True, **more):
    side = lambda which, t: {"homeAway": which, "score": t[2], "team": {"abbreviation": t[0], "shortDisplayName": t[1]}}
    status = {"type": {"state": state, "completed": completed, "shortDetail": detail}}
    return {"id": ident, "date": date, "status": status, "competitions": [{"competitors": [side("home", home), side("away", away)], "headlines": [{"shortLinkText": "recap"}], "status": status}]} | more


def boards(spark, *rows):
    return sports.events(spark.createDataFrame([(league, k, json.dumps({"events": e})) for league, k, e in rows], "league string, board int, body string"))


def test_games(spark):
    rows = boards(
        spark,
        ("mlb", 0, [event("1", "2026-06-12T23:05Z", "post", detail="Final/10"), event("2", "2026-06-12T23:05Z", "pre"), event("3", "2026-06-12T23:05Z", "post", home=("BOS", "Sox", "1"))]),
        ("mlb", 1, [event("1", "2026-06-12T23:05Z", "in", detail="Top 3"), event("4", "2026-06-13T23:05Z", "in", detail="Top 3"), event("5", "2026-06-13T23:05Z", "post", detail="", completed=False)]),
        ("nfl", 0, [event("6", "2026-09-13T17:00Z", "post", away=("WSH", "Commanders", "1"), season={"year": 2026, "type": 2}, week={"number": 1})]),
    )
    got = {(r.league, r.result): r for r in sports.games(rows, "PIT").collect()}
    assert set(got) == {("mlb", "Yankees 3 · Pirates 5 · Final (10)"), ("mlb", "Yankees 3 · Pirates 5 · Top 3 (in progress at last update)"), ("mlb", "Yankees @ Pirates · Postponed"), ("nfl", "Commanders 1 · Pirates 5 · Final")}
    first = got["mlb", "Yankees 3 · Pirates 5 · Final (10)"]
    assert (first.date, first.recap, first.url) == ("Fri Jun 12", "recap", "https://plaintextsports.com/mlb/2026-06-12/nyy-pit")
    assert got["nfl", "Commanders 1 · Pirates 5 · Final"].url == "https://plaintextsports.com/nfl/2026/week1/was-pit"


def test_next_game(spark):
    now = datetime(2026, 6, 12, 23, 5)
    rows = boards(spark, ("mlb", 0, [event("1", "2026-06-12T23:05Z", "pre"), event("2", "2026-06-27T23:05Z", None), event("3", "2026-06-27T23:06Z", "pre"), event("4", "2026-06-13T23:05Z", "post")]))
    got = sports.next_game(rows, F.lit(now)).collect()
    assert [(r.matchup, r.when) for r in got] == [("Yankees @ Pirates", "Sat Jun 27, 7:05 PM")]
    long = boards(spark, ("mlb", 0, [event("1", "2026-06-12T23:05Z", "post", away=("NYY", "Y" * 300, "3"))]))
    assert len(sports.games(long, "PIT").first().result) == 160
    teams = spark.createDataFrame([("mlb", "Pirates", "1-0"), ("nhl", "Penguins", "")], "league string, team string, record string")
    assert [r.team for r in sports.team_blocks(sports.games(rows, "PIT"), sports.next_game(rows, F.lit(now)), teams).collect()] == ["Pirates"]


def test_market(spark):
    day = 86400
    chart = lambda closes, start=1: json.dumps({"chart": {"result": [{"timestamp": [day * (start + k) for k in range(len(closes))], "indicators": {"quote": [{"close": closes}]}}]}})
    payloads = spark.createDataFrame([("a", chart([1000.0] * 5 + [1010.0] * 5)), ("b", chart([1.0] * 9)), ("c", chart([1.0, None] + [1.0] * 10)), ("d", chart([1.0] * 10 + [9.0], 90))], "symbol string, body string")
    closes = market.closes(payloads, F.lit("1970-04-11").cast("date"))
    assert {r.symbol: r["count"] for r in closes.groupBy("symbol").count().collect()} == {"a": 10, "b": 9, "c": 11, "d": 10}
    changes = market.weekly_change(closes, "symbol", "ts", "close")
    symbols = spark.createDataFrame([(0, "Alpha", "a", 2), (1, "See", "c", 4)], "pos int, label string, symbol string, digits int")
    lines = market.market_lines(market.market_rows(changes, symbols)).orderBy("pos").collect()
    assert [r.line for r in lines] == ["Alpha  1,010.00  ▲ +1.0%", "See      1.0000  = +0.0%"]


def test_weather(spark):
    period = lambda n, day: {"name": n, "shortForecast": "Sunny", "isDaytime": day, "temperature": 84, "temperatureUnit": "F"}
    body = json.dumps({"properties": {"periods": [period("Today", True), period("Tonight", False), period("Monday", True), period("Later", True)]}})
    got = weather.weather_lines(spark.createDataFrame([(body,)], "body string")).collect()
    assert [r.line for r in got] == ["Today: Sunny, high 84F.", "Tonight: Sunny, low 84F.", "Monday: Sunny, high 84F."]


ENTRY = "run_id string, pos int, kind string, text string, links array<struct<anchor:string,phrase:string>>"


def test_glance(spark):
    rows = [
        ("r", 0, "Trend", "Acme fixes ACME flaw", [("i-1", "acme"), ("i-2", "Acme"), ("i-9", "flaw")]),
        ("r", 1, "Update", "Acme again", [("i-1", "Acme")]),
        ("r", 2, "Odd", "Beta ships", [("i-3", "beta"), ("i-4", "eta")]),
        ("r", 3, "Trend", "No links", None),
        ("r", 4, "Trend", "  ", None),
        *[("r", 5 + k, "Trend", f"more {k}", None) for k in range(8)],
        ("s", 0, "Update", "Acme again", [("i-1", "Acme")]),
    ]
    catalog = spark.createDataFrame([(r, f"i-{k}", f"T{k}", s) for r in "rs" for k, s in ((1, "new"), (2, "unchanged"), (3, "updated"), (4, "new"))], "run_id string, anchor string, title string, status string")
    got = glance.glance(spark.createDataFrame(rows, ENTRY), catalog).collect()
    run = sorted((r for r in got if r.run_id == "r"), key=lambda r: r.pos)
    assert len(run) == 7
    assert [(x.anchor, x.start, x.end) for x in run[0].links] == [("i-1", 0, 4), ("i-2", 11, 15)]
    assert (run[1].kind, run[1].status, [x.anchor for x in run[1].links]) == ("Update", "updated", ["i-3"])
    assert run[0].status is None and run[2].text == "No links"
    assert [r.status for r in got if r.run_id == "s"] == ["new"]


def test_plain_entries_in_order(spark):
    trends = spark.createDataFrame([("r", 0, "Acme leads", "i-1", "Acme"), ("r", 1, "Nothing", None, None)], "run_id string, pos int, text string, linked string, link_phrase string")
    changed = spark.createDataFrame([("r", 0, "Beta ships", "i-2"), ("r", 1, "Acme leads", "i-1")], "run_id string, pos int, title string, anchor string")
    catalog = spark.createDataFrame([("r", "i-1", "A", "new"), ("r", "i-2", "B", "new")], "run_id string, anchor string, title string, status string")
    got = sorted(glance.glance(glance.plain_entries(trends, changed), catalog).collect(), key=lambda r: r.pos)
    assert [(r.kind, r.text) for r in got] == [("Trend", "Acme leads"), ("Trend", "Nothing"), ("Update", "Beta ships")]
    lines = render.glance_lines(spark.createDataFrame(got), F.lit(0)).orderBy("ord").collect()
    assert lines[0].line == "* [TREND] Acme leads" and lines[-1].line == "  see: B"


def test_rendering(spark):
    source = "array<struct<source:string,title:string,url:string>>"
    topics = spark.createDataFrame([("r", 1, "Big <news>", "Cloud", ["a", "b"], "latest", "sum", [("S", "t", "https://x"), ("T", "t", "ftp://y")], "i-1", 0)], f"run_id string, rank int, title string, area string, tags array<string>, latest_developments string, summary string, sources {source}, anchor string, pos int")
    lines = [r.line for r in render.topic_lines(topics, F.lit(1)).orderBy("ord").collect()]
    assert lines == ["", "1. BIG <NEWS>", "   Cloud · [a, b]", "   Latest developments: latest", "   sum", "   - S: https://x"]
    parts = render.story_lines(topics.limit(0), F.lit(2)), render.topic_lines(topics, F.lit(1))
    whole = render.briefing(["Glance", "Security", "Local"], *parts)
    assert [r.line for r in whole.orderBy("section", "ord").collect()][:3] == ["", "SECURITY", "-" * 64]
    assert render.contents(["Glance", "Security", "Local"], whole).first().contents == "Security"
    html = render.story_html(topics).first().html
    assert "Big &lt;news&gt;" in html and 'href="#"' in html
    links = spark.createDataFrame([("a <b> c", [("i-1", "b", 3, 4, ""), ("i-2", "x", 2, 9, "")])], "text string, links array<struct<anchor:string,phrase:string,start:int,end:int,title:string>>")
    assert links.select(render.linked_html(F.col("text"), F.col("links"))).first()[0] == 'a &lt;<a href="#i-1">b</a>&gt; c'


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    inbox = tmp_path / "in"
    source.repartition(3).write.parquet(str(inbox))
    stream = spark.readStream.schema(source.schema).parquet(str(inbox))
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    for _ in range(2):
        seen.append_log(stream, log, checkpoint, ["user_id", "props"]).awaitTermination()
    got = spark.read.parquet(log)
    assert got.count() == source.select("user_id", "props").distinct().count()


def test_stream_counts(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = seen.hourly_counts(stream, "event_type", "ts").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == source.count()
