from datetime import datetime, timedelta

from pyspark.sql import functions as F

from briefspark.operators import archive, diffing, profile, ranking, selection, validation

NOW = datetime(2026, 6, 10, 12)
ITEM = "group string, source string, title string, url string, published timestamp, summary string"


def items(spark, rows):
    return spark.createDataFrame([(g, "s", t, u, p, "") for g, t, u, p in rows], ITEM)


def test_bounds_are_inclusive(spark):
    us = timedelta(microseconds=1)
    rows = [("g", str(k), str(k), t) for k, t in enumerate([NOW - timedelta(hours=24), NOW + timedelta(hours=2), NOW - timedelta(hours=24) - us, NOW + timedelta(hours=2) + us, None])]
    got = selection.recent_items(items(spark, rows), F.lit(NOW), 24, 10)
    assert {r.title for r in got.collect()} == {"0", "1"}


def test_newest_of_a_title_stays_per_group(spark):
    rows = [("g", "Foo: Bar!", "old", NOW - timedelta(hours=3)), ("g", "foo bar", "new", NOW), ("h", "foo bar", "other", NOW), ("g", "?!", "a", NOW), ("g", "...", "b", NOW - timedelta(hours=1))]
    got = selection.recent_items(items(spark, rows), F.lit(NOW), 24, 10)
    assert {r.url for r in got.collect()} == {"new", "other", "a"}


def test_cap_and_order(spark):
    rows = [("g", f"t{k}", f"u{k}", NOW - timedelta(minutes=k)) for k in range(9)]
    got = selection.recent_items(items(spark, rows), F.lit(NOW), 24, 3).orderBy("rank").collect()
    assert [(r.url, r.rank) for r in got] == [("u0", 1), ("u1", 2), ("u2", 3)]


def test_window_widens_below_the_least(spark):
    for n, hours in ((11, 48), (12, 24)):
        rows = [("g", f"t{k}", f"u{k}", NOW - timedelta(minutes=k)) for k in range(n)] + [("g", "old", "old", NOW - timedelta(hours=30))]
        got = selection.adaptive_window(items(spark, rows), F.lit(NOW), 24, 48, 12, 120).collect()
        assert {r.window_hours for r in got} == {hours}
        assert len(got) == (n if hours == 24 else n + 1)


def test_empty(spark):
    assert selection.recent_items(items(spark, []), F.lit(NOW), 24, 3).count() == 0
    assert selection.adaptive_window(items(spark, []), F.lit(NOW), 24, 48, 12, 120).count() == 0


def test_index_keeps_the_oldest(spark):
    got = ranking.oldest_by_key(items(spark, [("g", "a", " U ", NOW), ("g", "b", "u", NOW - timedelta(hours=1)), ("g", "c", None, NOW)]), F.lower(F.trim("url")), "published")
    assert [(r.key, r.published) for r in got.collect()] == [("u", NOW - timedelta(hours=1))]


def test_topic_order(spark):
    topics = spark.createDataFrame([(0, NOW, 1), (1, NOW - timedelta(hours=1), 3), (2, None, 9), (3, NOW, 1)], "pos int, recency timestamp, n long")
    got = ranking.topic_rank(topics, [], "recency", "n", F.col("pos")).orderBy("rank").collect()
    assert [r.pos for r in got] == [1, 0, 3, 2]


def test_anchors_are_unique(spark):
    rows = spark.createDataFrame([(0, "i-1"), (1, "i-1"), (2, None), (3, "i-1"), (4, "i-2")], "pos int, base string")
    got = {r.pos: r.anchor for r in ranking.unique_anchors(rows, "base", ["pos"]).collect()}
    assert got == {0: "i-1", 1: "i-1-2", 2: None, 3: "i-1-3", 4: "i-2"}


def test_changes(spark):
    prior = diffing.last_text(spark.createDataFrame([("a", "x", 0), ("a", "Same  text", 1), ("b", "", 0), ("c", "old", 0)], "key string, t string, seq int"), "key", F.col("t"), "seq")
    now = spark.createDataFrame([("a", "same text"), ("b", "anything"), ("c", "New"), ("d", None), ("", "no key")], "key string, t string")
    got = {r.key: (r.status, r.new_text, r.old_text) for r in diffing.changes(now, prior, "key", "t").collect()}
    assert got == {"c": ("updated", "New", "old"), "d": ("new", "", None)}


def test_digest_problems(spark):
    heads = spark.createDataFrame([("ok", "h"), ("bad", " "), ("none", "h")], "run_id string, headline string")
    topics = spark.createDataFrame([("ok", 0, "t", "l", "s"), ("bad", 0, "t", "", "s"), ("bad", 1, "t", "l", "s")], "run_id string, pos int, title string, latest_developments string, summary string")
    trends = spark.createDataFrame([("ok", "x"), ("bad", " "), ("none", "y")], "run_id string, text string")
    citations = spark.createDataFrame([("ok", 0), ("bad", 0)], "run_id string, pos int")
    got = {(r.run_id, r.problem) for r in validation.digest_problems(topics, trends, F.col("headline"), heads, citations).collect()}
    assert got == {("bad", "missing headline"), ("bad", "topic 0: missing latest_developments"), ("bad", "topic 1: no valid sources"), ("bad", "trends need text"), ("none", "missing topics")}


def test_local_items_drop_quietly(spark):
    rows = spark.createDataFrame([("events", 0, " a ", "b", None), ("events", 1, "a", "b", "c"), ("events", 2, "", "b", "c")], "section string, pos int, title string, latest_developments string, summary string")
    got = validation.local_items(rows, spark.createDataFrame([("events", 0), ("events", 2)], "section string, pos int")).collect()
    assert [(r.title, r.summary) for r in got] == [("a", "")]


def test_normalized_topics(spark):
    rows = spark.createDataFrame([(" ", ["a", None]), (None, None), ("X", [])], "area string, tags array<string>")
    assert [(r.area, r.tags) for r in validation.normalize_topics(rows).collect()] == [("Other", ["a"]), ("Other", []), ("X", [])]


def test_lags(spark):
    for n, at in ((1, 0), (5, 3), (16, 13)):
        rows = spark.createDataFrame([("g", NOW, NOW + timedelta(hours=k)) for k in range(n)], "g string, a timestamp, b timestamp")
        got = {r.g: r.p90_hours for r in profile.lag_report(rows, "g", "a", "b").collect()}
        assert got == {"g": float(at), "ALL": float(at)}


def test_lags_within_a_minute_and_without_a_group(spark):
    rows = spark.createDataFrame([(g, NOW, NOW + timedelta(milliseconds=k)) for g, n in (("g", 20), (None, 4)) for k in range(n)] + [("g", NOW, None)], "g string, a timestamp, b timestamp")
    got = {r.g: (round(r.median_hours * 3.6e6, 6), round(r.p90_hours * 3.6e6, 6), r.n) for r in profile.lag_report(rows, "g", "a", "b").collect()}
    assert got == {"g": (9.5, 17.0, 20), None: (1.5, 3.0, 4), "ALL": (7.5, 17.0, 24)}


def test_first_of_a_key_with_a_column_named_alike(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, n int, __rn string")
    assert sorted(tuple(r) for r in selection.keep_first(rows, ["k"], [F.col("n")]).collect()) == [("a", 1, "y"), ("b", 3, "z")]


def test_log_and_runs(spark):
    rows = items(spark, [("g", "a", " u ", datetime(2026, 1, 5, 2)), ("g", "b", "", NOW), ("g", "c", "v", None)])
    got = profile.log_rows(rows, F.lit(NOW)).collect()
    assert [(r.url, r.published_et_hour, r.published_weekday) for r in got] == [("u", 21, "Sunday")]
    assert profile.run_row(spark, NOW, 3, ["x"], 5).first().feeds_failed == 1


def test_archive(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = lambda *r: spark.createDataFrame(r, "run_date string, run_ts string, headline string")
    archive.save_runs(runs(("2026-06-01", "1", "a"), ("2026-06-02", "2", "b")), path)
    archive.save_runs(runs(("2026-06-02", "3", "c"), ("2026-06-02", "4", "d")), path)
    kept = archive.load_runs(spark, path)
    assert sorted(r.headline for r in kept.collect()) == ["a", "c", "d"]
    assert archive.latest_run(kept).first().headline == "d"
    assert sorted(r.headline for r in archive.last_of_day(kept).collect()) == ["a", "d"]
    assert archive.load_runs(spark, path, "2026-06-02").count() == 2
    day, today = F.to_date("run_date"), F.lit("2026-06-03").cast("date")
    assert archive.expired(kept, day, today, 1).count() == 1
    assert archive.expired(kept, day, today, 0).count() == 0
    assert archive.retained(kept, day, today, 1).count() == 2


def test_stems(spark):
    got = archive.stem_index(spark.createDataFrame([("2026-06-12",), ("2026-06-12-0702",), ("index",), ("junk",), ("2026-06-13-0100",)], "stem string")).collect()
    assert [(r.day, [x.label for x in r.runs]) for r in got] == [("2026-06-13", ["01:00"]), ("2026-06-12", ["07:02", "briefing"])]


def test_history_lines(spark):
    rows = spark.createDataFrame([("d", "events", 0, "t", "l"), ("d", "events", 1, None, "only"), ("d", "x", 0, "", " "), ("e", "x", 0, "", "")], "date string, section string, pos int, title string, latest string")
    got = diffing.history(rows, "date", "section", ["pos"], diffing.history_line(F.col("title"), F.col("latest")), ["events", "x"]).collect()
    assert [(r.date, r.events, r.x) for r in got] == [("d", ["t — l", "only"], [])]
