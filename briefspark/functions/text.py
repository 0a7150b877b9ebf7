"""Text and URL expressions. All are built-in functions but HTML unescaping and wrapping."""

from __future__ import annotations

import html
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a tag, as a control character, and as white space.
TAG = r"(?s)</?[A-Za-z][^>]*>|<!--.*?-->"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
BLANK = r"(?U)[\s\x1c-\x1f]+"


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def drop_controls(text: Column) -> Column:
    """Without control characters but tab and line feed; a carriage return vanishes."""
    return F.regexp_replace(text, CONTROL, "")


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` code points: cut at the last space before the limit and end in three dots."""
    head = F.substring(text, 1, limit - 3)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit("..."))).otherwise(text)


@F.pandas_udf(StringType())
def unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references as characters, those without a semicolon too."""
    for batch in texts:
        yield batch.map(html.unescape, na_action="ignore")


def clean_html(text: Column, limit: int) -> Column:
    """Plain text of markup: tags out, references decoded, escaped tags out, one line, cut to ``limit``.

    Only text with an ampersand goes through Python.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, " ")
    decoded = F.coalesce(unescape(F.when(bare.contains("&"), bare)), bare)
    return truncate_words(squeeze(drop_controls(F.regexp_replace(decoded, TAG, " "))), limit)


def title_key(title: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", "")


def norm_url(url: Column) -> Column:
    return F.lower(F.trim(F.coalesce(url, F.lit(""))))


def norm_text(text: Column) -> Column:
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def anchor(url: Column) -> Column:
    """A stable id for a URL; null for none."""
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("i-"), F.substring(F.sha1(norm_url(url)), 1, 10)))


def is_web(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def escape_html(text: Column) -> Column:
    # Ampersand first.
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def safe_url(url: Column) -> Column:
    return F.when(is_web(url), escape_html(url)).otherwise("#")


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def thousands(value: Column, digits: int) -> Column:
    return F.format_number(value, digits)


def signed_percent(value: Column) -> Column:
    """One decimal, rounded half to even, always with a sign."""
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.format_number(F.abs(value), 1), F.lit("%"))


def arrow(percent: Column) -> Column:
    return F.when(F.abs(percent) < 0.05, "=").when(percent > 0, "▲").otherwise("▼")


def wrapped(text: Column, width: int = 64, first: str = "", rest: str | None = None) -> Column:
    """Lines of at most ``width``; long words and hyphens aren't broken. Presentation only."""
    rest = first if rest is None else rest

    @F.pandas_udf(StringType())
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: textwrap.fill(t, width=width, initial_indent=first, subsequent_indent=rest, break_long_words=False, break_on_hyphens=False), na_action="ignore")

    return wrap(text)
