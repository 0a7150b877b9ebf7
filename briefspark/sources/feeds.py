"""Feeds as a Spark data source: RSS 2.0, RSS 1.0 and Atom from the web, behind a guard, or from files where that is allowed."""

from __future__ import annotations

import gzip
import io
import ipaddress
import json
import os
import re
import socket
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from briefspark.functions.dates import parse_date_text
from briefspark.functions.text import clean_html

# Sizes, times and groups that feeds are read with.
LIMIT, BODY_LIMIT = 8 << 20, 4_000_000
TITLE_CHARS, SUMMARY_CHARS = 250, 480
TIMEOUT, HOPS = 25, 10
GROUPS = ("security", "pittsburgh", "bizpol", "events", "sports_media", "team_usa", "reading")
HEADERS = {"User-Agent": "briefspark/1.0", "Accept-Encoding": "gzip", "Accept": "application/rss+xml, application/atom+xml, application/xml;q=0.9, */*;q=0.8"}


class Rejected(ValueError):
    """A URL that may not be fetched, or markup that may not be parsed."""


# --- fetching --------------------------------------------------------------------------


@dataclass
class Target:
    """Where a URL leads; addresses are looked up when they are first asked for."""

    url: str
    resolve: Callable

    @cached_property
    def parts(self):
        return urlsplit(self.url)

    @cached_property
    def addresses(self) -> list:
        default = {"http": 80, "https": 443}[self.parts.scheme]
        try:
            answers = self.resolve(self.parts.hostname, self.parts.port or default, proto=socket.IPPROTO_TCP)
        except OSError:
            return []
        found = [ipaddress.ip_address(a[4][0].partition("%")[0]) for a in answers]
        return [getattr(ip, "ipv4_mapped", None) or ip for ip in found]


#: Kinds of addresses that the registry calls global but that no feed is at.
UNFIT = ("is_multicast", "is_reserved", "is_unspecified", "is_loopback", "is_link_local", "is_private")
#: What a URL has to meet before anything is sent to it, in this order.
POLICY: list[tuple[str, Callable[[Target], bool]]] = [
    ("its scheme isn't http or https", lambda t: t.parts.scheme in ("http", "https")),
    ("it has no host", lambda t: bool(t.parts.hostname)),
    ("its host has no address", lambda t: bool(t.addresses)),
    ("its host isn't public", lambda t: all(ip.is_global and not any(getattr(ip, k) for k in UNFIT) for ip in t.addresses)),
]


def check_url(url: str, resolve=socket.getaddrinfo) -> str:
    """``url`` if it meets the policy."""
    target = Target(url, resolve)
    broken = next((what for what, met in POLICY if not met(target)), None)
    if broken:
        raise Rejected(f"{url}: {broken}")
    return url


def unpack(raw: bytes, encoding: str = "", limit: int = LIMIT) -> bytes:
    """Gunzip if the header or the first bytes say so; more than ``limit`` bytes before or after is an error."""
    packed = "gzip" in encoding or raw.startswith(b"\x1f\x8b")
    if packed and len(raw) <= limit:
        try:
            raw = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(limit + 1)
        except (OSError, EOFError, zlib.error) as e:
            raise Rejected(f"bad gzip: {e}") from e
    if len(raw) > limit:
        raise Rejected(f"over {limit} bytes")
    return raw


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects come back as errors, so that each hop is checked like the first address."""

    def redirect_request(self, *_):
        return None


def fetch(url: str, local: bool = False, limit: int = LIMIT, resolve=socket.getaddrinfo) -> bytes:
    """The body at ``url``. Files are read only if ``local``; else whatever isn't on the public web is rejected."""
    if local and urlsplit(url).scheme in ("", "file"):
        with open(url.removeprefix("file://"), "rb") as f:
            return unpack(f.read(limit + 1), limit=limit)
    opener = urllib.request.build_opener(_Stay)
    for _ in range(HOPS):
        try:
            with opener.open(urllib.request.Request(check_url(url, resolve), headers=HEADERS), timeout=TIMEOUT) as response:
                return unpack(response.read(limit + 1), response.headers.get("Content-Encoding", ""), limit)
        except HTTPError as e:
            onward = e.headers.get("Location") if 300 <= e.code < 400 else None
            if not onward:
                raise
            url = urljoin(url, onward)
    raise Rejected(f"over {HOPS} redirects")


# --- parsing ---------------------------------------------------------------------------

# Where the entries of each kind of feed stand.
ENTRIES = {"rss": ("rss", "channel", "item"), "RDF": ("RDF", "item"), "feed": ("feed", "entry")}
PROLOG = re.compile(rb"(?:\xef\xbb\xbf|\s)*")
PIECE = 1 << 16


@dataclass
class Node:
    """An element below an entry: its local name, attributes, the text before its first child, and children."""

    name: str
    attrs: dict[str, str]
    text: str = ""
    children: list[Node] = field(default_factory=list)


class EntryParser:
    """Entries of a feed as they close; nothing else of the document is kept. DTDs and entities end the parse."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.open: list[Node] = []
        self.closed: list[Node] = []
        self.kind, self.channels = "", 0
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._text
        for forbidden in ("StartDoctypeDecl", "EntityDecl", "UnparsedEntityDecl", "ExternalEntityRef"):
            setattr(self.parser, f"{forbidden}Handler", self._refuse)

    @staticmethod
    def _refuse(*_):
        raise Rejected("DTD and entity declarations aren't allowed")

    def _start(self, tag: str, attrs: dict) -> None:
        name = tag.rpartition("}")[2]
        if not self.path:
            if name not in ENTRIES:
                raise Rejected(f"<{name}> isn't a feed")
            self.kind = name
        self.path.append(name)
        self.channels += self.path == ["rss", "channel"]
        if self.open or (tuple(self.path) == ENTRIES[self.kind] and self.channels < 2):
            node = Node(name, attrs)
            if self.open:
                self.open[-1].children.append(node)
            self.open.append(node)

    def _text(self, data: str) -> None:
        if self.open and not self.open[-1].children:
            self.open[-1].text += data

    def _end(self, _: str) -> None:
        self.path.pop()
        if self.open and (node := self.open.pop()) and not self.open:
            self.closed.append(node)

    def run(self, raw: bytes) -> Iterator[Node]:
        raw = raw[PROLOG.match(raw).end() :]
        try:
            for at in range(0, len(raw) + 1, PIECE):
                self.parser.Parse(raw[at : at + PIECE], at + PIECE > len(raw))
                yield from self.closed
                self.closed.clear()
        except expat.ExpatError as e:
            raise Rejected(f"bad markup: {e}") from e


def first_text(entry: Node, *names: str) -> str:
    """Text of the first child, in document order, that has one of the names and own text that isn't blank."""
    return next((t for c in entry.children if c.name in names and (t := c.text.strip())), "")


def _link(entry: Node) -> str:
    """The first alternate link, else the first of any kind."""
    links = [c.attrs for c in entry.children if c.name == "link" and c.attrs.get("href")]
    return next(iter(sorted(links, key=lambda a: a.get("rel", "alternate") != "alternate")), {}).get("href", "")


def _enclosure(entry: Node) -> str:
    return next((c.attrs.get("url", "") for c in entry.children if c.name == "enclosure"), "")


def _deep_description(entry: Node) -> str:
    return next((first_text(c, "description") for c in entry.children if c.name == "group"), "")


def _texts(*names: str) -> Callable[[Node], str]:
    return lambda entry: first_text(entry, *names)


any_text = bool
is_web_text = re.compile("https?://").match
#: For each field the places it is looked for, in order: where, what is good there, and which kinds of feed have no such place.
FIELDS: dict[str, list[tuple[Callable[[Node], str], Callable, tuple[str, ...]]]] = {
    "title": [(_texts("title"), any_text, ())],
    "url": [(_texts("link"), any_text, ("feed",)), (_link, any_text, ()), (_texts("guid"), is_web_text, ()), (_enclosure, is_web_text, ())],
    "date": [(_texts("pubDate", "published", "updated", "date"), any_text, ())],
    "summary": [(_texts("description", "summary", "content", "encoded"), any_text, ()), (_deep_description, any_text, ())],
}


def extracted(entry: Node, kind: str, name: str) -> str:
    found = (place(entry) for place, _, absent in FIELDS[name] if kind not in absent)
    good = (ok for _, ok, absent in FIELDS[name] if kind not in absent)
    return next((value.strip() for value, ok in zip(found, good, strict=True) if ok(value)), "")


def raw_items(raw: bytes) -> list[tuple[str, ...]]:
    """(title, url, date, summary) of each entry, as they stand in the feed; broken markup anywhere spoils all of it."""
    parser = EntryParser()
    return [tuple(extracted(entry, parser.kind, name) for name in FIELDS) for entry in parser.run(raw)]


# --- data source -----------------------------------------------------------------------


@dataclass
class FeedPartition(InputPartition):
    group: str
    name: str
    url: str


class FeedReader(DataSourceReader):
    """One partition a feed. A feed that can't be read is a row with its error: nothing of it is kept."""

    def __init__(self, options) -> None:
        self.feeds = json.loads(options["feeds"])
        self.local = options.get("local", "false").lower() == "true"

    def partitions(self):
        return [FeedPartition(*f) for f in self.feeds] or [FeedPartition("", "", "")]

    def read(self, partition):
        if not partition.url:
            return
        try:
            items = raw_items(fetch(partition.url, self.local))
        except Exception as e:  # any failure is the feed's own
            yield (partition.group, partition.name, False, str(e)[:300], None, None, None, None, None)
            return
        yield (partition.group, partition.name, True, None, None, None, None, None, None)
        for n, (title, url, date, summary) in enumerate(items):
            yield (partition.group, partition.name, True, None, n, title, url, parse_date_text(date), summary)


class FeedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "group string, source string, ok boolean, error string, seq int, title string, url string, published timestamp, summary string"

    def reader(self, schema):
        return FeedReader(self.options)


def load_config(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(group, name, url) of a JSON file of groups; all groups have to be there."""
    feed = "array<struct<name:string,url:string>>"
    row = spark.read.schema(", ".join(f"{g} {feed}" for g in GROUPS)).json(path, multiLine=True).first()
    if row is None or (missing := [g for g in GROUPS if row[g] is None]):
        raise ValueError(f"no feeds for {missing if row else GROUPS}")
    return [(g, f["name"], f["url"]) for g in GROUPS for f in row[g]]


def read_feeds(spark: SparkSession, feeds: list[tuple[str, str, str]], local: bool = False) -> DataFrame:
    """Rows of all feeds: one that tells whether it could be read, and its entries. Files are read only if ``local``."""
    spark.dataSource.register(FeedDataSource)
    return spark.read.format("feed").option("feeds", json.dumps(feeds)).option("local", str(local).lower()).load()


def feed_items(rows: DataFrame) -> DataFrame:
    """Cleaned entries that have a title and a URL."""
    cleaned = rows.filter("ok and seq is not null").select("group", "source", clean_html(F.col("title"), TITLE_CHARS).alias("title"), F.trim("url").alias("url"), "published", clean_html(F.col("summary"), SUMMARY_CHARS).alias("summary"), "seq")
    return cleaned.filter("title <> '' and url <> ''")


def feed_health(rows: DataFrame) -> DataFrame:
    """Per group the feeds that could be read, and the names of those that couldn't."""
    return rows.filter("seq is null").groupBy("group").agg(F.count_if("ok").alias("loaded"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("source")))).alias("failed"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank and malformed lines are skipped."""
    columns = spark.createDataFrame([], schema).columns
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"}).alias("r"))
    return parsed.filter("r is not null and r.__corrupt is null").select(*(F.col(f"r.`{c}`") for c in columns))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, error) of JSON files that an API returned; of one over 4 MB only the error is there."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= BODY_LIMIT
    return files.select("path", F.when(fits, F.decode("content", "UTF-8")).alias("body"), F.when(~fits, F.concat(F.lit("over "), F.lit(BODY_LIMIT), F.lit(" bytes"))).alias("error"))


def feed_files(folder: str, group: str = "security") -> list[tuple[str, str, str]]:
    return [(group, os.path.splitext(n)[0], os.path.join(folder, n)) for n in sorted(os.listdir(folder))]
