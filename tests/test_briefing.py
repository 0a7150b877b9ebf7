import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from briefspark.operators import archive
from briefspark.plans import briefing, report
from briefspark.sources import feeds

NOW = datetime(2026, 6, 9, 14)


def rss(*items):
    body = "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>Tue, 09 Jun 2026 {h}:00:00 GMT</pubDate><description>{d}</description></item>" for t, u, h, d in items)
    return f"<rss><channel>{body}</channel></rss>"


def read(spark, folder, **contents):
    folder.mkdir(exist_ok=True)
    rows = []
    for name, content in contents.items():
        (folder / f"{name}.xml").write_text(content)
        rows.append((name.split("_")[0], name, str(folder / f"{name}.xml")))
    return feeds.read_feeds(spark, rows, local=True)


def test_two_runs(spark, tmp_path):
    store = str(tmp_path / "store")
    first = dict(
        security_a=rss(("Acme firewall flaw", "http://a/1", "10", "Patch now"), ("Lone story", "http://a/2", "09", "Text")),
        security_b=rss(("Firewall makers respond", "http://b/1", "11", "They say")),
        bizpol_c=rss(("Markets rise", "http://c/1", "12", "Up")),
    )
    page = briefing.run(spark, read(spark, tmp_path / "in", **first), store, NOW)
    lines = [r.line for r in page.collect()]
    archive.save_page(page, str(tmp_path / "page"))
    assert [r.value for r in spark.read.text(str(tmp_path / "page")).collect()] == [x for line in lines for x in line.split("\n")]
    assert "SECURITY" in lines and "BUSINESS AND POLITICS" in lines and "EVENTS" not in lines
    assert not any("[UPDATE" in x for x in lines)
    stories = spark.read.parquet(store)
    firewall = stories.filter("title = 'Firewall makers respond'").first()
    assert [s.url for s in firewall.sources] == ["http://b/1", "http://a/1"] and firewall.pos == 1
    assert firewall.anchor.startswith("i-") and stories.select("anchor").distinct().count() == stories.count()

    first["bizpol_c"] = rss(("Markets rise", "http://c/1", "12", "Up again"), ("Fresh", "http://c/2", "13", "New one"))
    later = [r.line for r in briefing.run(spark, read(spark, tmp_path / "in2", **first), store, NOW.replace(hour=15)).collect()]
    assert any("[UPDATE (new)] Fresh" in x for x in later) and any("[UPDATE (updated)] Markets rise" in x for x in later)
    assert not any("Lone story" in x and "UPDATE" in x for x in later)
    html = [r.value for r in spark.read.text(f"{store}/_pages/2026-06-09-150000.html").collect()]
    assert html[0].startswith("<!DOCTYPE html>") and html[-1] == "</body></html>"
    assert '<a href="#s1">Security</a>' in html and '<h2 id="s1">Security</h2>' in html and any(firewall.anchor in x for x in html)
    record = spark.read.parquet(f"{store}/_runs").orderBy("run_ts").collect()
    assert [(r.items, r.stories, r.new, r.updated, r.drafts) for r in record] == [(4, 3, 0, 0, 1), (5, 4, 1, 1, 1)]
    assert [(f["group"], f.loaded) for f in record[0].feeds] == [("bizpol", 1), ("security", 2)]
    memory = briefing.covered(spark, store, NOW).collect()
    assert [(str(r.date), sorted(t.title for t in r.topics)) for r in memory] == [("2026-06-09", ["Firewall makers respond", "Lone story"])]


def test_all_problems_are_told(spark, tmp_path):
    rows = read(spark, tmp_path / "in", security_a=rss(("Story", "http://a/1", "10", "x")), security_b=rss(("Other", "http://b/1", "10", "x")), reading_c=rss(("Post", "http://c/1", "10", "x")))

    def blank(items, notes):
        made = briefing.cluster(items).filter("section <> 'Reading'")
        return made.withColumns({"title": F.when(F.col("pos") == 1, " ").otherwise(F.col("title")), "summary": F.lit("")})

    with pytest.raises(briefing.Unfit) as e:
        briefing.run(spark, rows, str(tmp_path / "store"), NOW, blank, attempts=1)
    assert e.value.problems == ("topic 1: missing summary", "topic 1: missing title", "topic 2: missing summary", "Reading: no story, though there are items")


def test_payloads_page_and_retention(spark, tmp_path):
    store = tmp_path / "store"
    rows = read(spark, tmp_path / "in", security_a=rss(("Story", "http://a/1", "10", "x")), security_b=rss(("Other", "http://b/1", "10", "x")))
    for day in ("2026-03-10", "2026-03-11"):
        (store / f"run_date={day}").mkdir(parents=True)
    day = 86400
    chart = {"chart": {"result": [{"timestamp": [day * k for k in range(1, 11)], "indicators": {"quote": [{"close": [1000.0] * 5 + [1010.0] * 5}]}}]}}
    periods = [{"name": "Today", "shortForecast": "Sunny", "isDaytime": True, "temperature": 84, "temperatureUnit": "F"}]
    side = lambda where, name, score: {"homeAway": where, "score": score, "team": {"abbreviation": name, "shortDisplayName": name.title()}}
    status = {"type": {"state": "post", "completed": True, "shortDetail": "Final"}}
    game = {"id": "1", "date": "2026-06-08T23:05Z", "status": status, "competitions": [{"competitors": [side("home", "PIT", "4"), side("away", "NYY", "3")], "status": status}]}
    extras = briefing.Extras(
        spark.createDataFrame([("^DJI", json.dumps(chart))], "symbol string, body string"),
        spark.createDataFrame([(json.dumps({"properties": {"periods": periods}}),)], "body string"),
        spark.createDataFrame([("mlb", 0, json.dumps({"events": [game]}))], "league string, board int, body string"),
        spark.createDataFrame([(0, "mlb", "Pirates", "1-0"), (1, "nhl", "Penguins", "")], "pos int, league string, team string, record string"),
    )
    lines = [r.line for r in briefing.run(spark, rows, str(store), NOW, extras=extras).collect()]
    heads = [x for x in lines if x.isupper() and not x[0].isdigit()]
    assert heads == ["SECURITY", "WEATHER", "SPORTS", "MARKETS (WEEKLY AVERAGE, CHANGE VS PRIOR WEEK)"]
    assert "  Today: Sunny, high 84F." in lines and "Dow  1,010.00  ▲ +1.0%" in lines
    at = lines.index("Pirates (1-0)")
    assert lines[at + 1].endswith("Nyy 3 · Pit 4 · Final") and lines[at + 2] == "    https://plaintextsports.com/mlb/2026-06-08/nyy-pit"
    assert not any("Penguins" in x for x in lines)
    assert sorted(p.name for p in store.glob("run_date=*")) == ["run_date=2026-03-11", "run_date=2026-06-09"]
    assert [r.value for r in spark.read.text(str(store / "_pages" / "2026-06-09-140000")).collect()] == [y for x in lines for y in x.split("\n")]


def test_unfit(spark, tmp_path):
    rows = read(spark, tmp_path / "in", security_a=rss(("Story", "http://a/1", "10", "x")))
    with pytest.raises(briefing.Unfit, match="only 1 security"):
        briefing.run(spark, rows, str(tmp_path / "store"), NOW)


def test_uncited_draft_is_asked_for_again(spark, tmp_path):
    rows = read(spark, tmp_path / "in", security_a=rss(("Story", "http://a/1", "10", "x")), security_b=rss(("Other", "http://b/1", "10", "x")))
    calls = []

    def invent(items, notes):
        calls.append(notes.problems)
        made = briefing.cluster(items)
        return made if len(calls) > 1 else made.withColumn("sources", F.transform("sources", lambda s: s.withField("url", F.lit("http://made/up"))))

    briefing.run(spark, rows, str(tmp_path / "store"), NOW, invent)
    assert calls == [(), ("topic 1: no valid sources", "topic 2: no valid sources", "missing topics")]
    calls.clear()
    with pytest.raises(briefing.Unfit, match="no valid sources"):
        briefing.run(spark, rows, str(tmp_path / "s2"), NOW, invent, attempts=1)


def test_report(spark, tmp_path):
    rows = read(spark, tmp_path / "in", security_a=rss(("Story", "http://a/1", "10", "x"), ("Again", "http://a/1", "11", "x"), ("Next", "http://a/2", "11", "x")))
    items, path = feeds.feed_items(rows), str(tmp_path / "log")
    assert report.append(items, None, path, F.lit(NOW)) == 2
    log = spark.read.parquet(path)
    assert report.append(items, log, path, F.lit(NOW)) == 0
    blocks = {r["group"]: r for r in report.report(log)["blocks"].collect()}
    assert blocks["reading"].n == 0 and blocks["reading"].h08_12 is None and blocks["ALL"].n == 2
    lags = {r["group"]: r for r in report.report(log)["lags"].collect()}
    assert (lags["security"].median_hours, lags["security"].p90_hours, lags["events"].n) == (3.5, 4.0, 0)
    shown = report.text(report.report(spark.read.parquet(path)))
    assert "LAGS" in shown and "ALL" in shown
