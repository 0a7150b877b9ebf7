from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from briefspark.functions import dates, text


def value(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], names).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("versions < 2.4 are bad", "versions < 2.4 are bad"),
        ("&lt;b&gt;x&lt;/b&gt;", "x"),
        ("a  b\tc\nd", "a b c d"),
        ("a\rb", "ab"),
        ("<p>one<!-- no\nmore -->two</p>", "one two"),
        ("AT&ampT &copy; &#8217;", "AT&T © ’"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_html(spark, raw, want):
    assert value(spark, text.clean_html(F.col("t"), 480), t=raw) == want


def test_truncate(spark):
    assert value(spark, text.truncate_words(F.col("t"), 12), t="hello big world") == "hello..."
    assert value(spark, text.truncate_words(F.col("t"), 10), t="abcdefghijkl") == "abcdefg..."
    assert value(spark, text.truncate_words(F.col("t"), 10), t="a 😀😀😀😀😀😀😀😀") == "a 😀😀😀😀😀😀😀😀"


def test_keys(spark):
    assert value(spark, text.title_key(F.col("t")), t="Foo: Bar_1!") == "foobar_1"
    assert value(spark, text.title_key(F.col("t")), t="?!") == ""
    assert value(spark, text.norm_url(F.col("t")), t="  HTTP://X/Path ") == "http://x/path"
    assert value(spark, text.anchor(F.col("t")), t="") is None
    assert value(spark, text.anchor(F.col("t")), t="https://A") == value(spark, text.anchor(F.col("t")), t=" https://a ")
    assert value(spark, text.first_nonempty(F.col("a"), F.col("b"), F.col("c")), a=None, b="", c="z") == "z"


def test_numbers(spark):
    show = lambda x: spark.range(1).select(text.signed_percent(F.lit(x)), text.arrow(F.lit(x))).first()
    assert tuple(show(0.25)) == ("+0.2%", "▲")
    assert tuple(show(-1.0)) == ("-1.0%", "▼")
    assert [show(x)[1] for x in (0.0499, -0.0499, 0.05)] == ["=", "=", "▲"]
    assert spark.range(1).select(text.thousands(F.lit(1234567.125), 2)).first()[0] == "1,234,567.12"


def test_json_object(spark):
    assert value(spark, text.json_object(F.col("t")), t='```json\n{"a": {"b": 1}}\n``` done') == '{"a": {"b": 1}}'
    assert value(spark, text.json_object(F.col("t")), t="none") is None


def test_wrapped(spark):
    assert value(spark, text.wrapped(F.col("t"), 10, "* ", "  "), t="one two three four") == "* one two\n  three\n  four"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Tue, 09 Jun 2026 10:00:00 GMT", datetime(2026, 6, 9, 10)),
        ("Tue, 09 Jun 2026 10:00:00 EST", datetime(2026, 6, 9, 15)),
        ("2026-06-09T10:00:00Z", datetime(2026, 6, 9, 10)),
        ("2026-06-09T10:00:00+02:00", datetime(2026, 6, 9, 8)),
        ("2026-06-09 10:00", datetime(2026, 6, 9, 10)),
        ("20260609T100000", datetime(2026, 6, 9, 10)),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, raw, want):
    assert dates.parse_date_text(raw) == (want and want.replace(tzinfo=timezone.utc))
    got = spark.createDataFrame([(raw,)], "t string").select(F.date_format(dates.parse_date(F.col("t")), "yyyy-MM-dd HH:mm")).first()[0]
    assert got == (want and want.strftime("%Y-%m-%d %H:%M"))


def test_dates_shown(spark):
    assert value(spark, dates.long_date(F.col("t")), t="2026-08-09") == "Sunday, August 9, 2026"
    assert value(spark, dates.long_date(F.col("t")), t="later") == "later"
    assert value(spark, dates.game_time(F.col("t").cast("timestamp")), t="2026-06-14 23:05:00") == "Sun Jun 14, 7:05 PM"
