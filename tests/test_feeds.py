import gzip
import socket

import pytest

from briefspark.sources import feeds

RSS = b"""\xef\xbb\xbf
<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>
<item><title>A &amp;amp; B</title><link>http://x/1</link><pubDate>Tue, 09 Jun 2026 10:00:00 GMT</pubDate><description><![CDATA[<p>Hello <b>you</b></p>]]></description></item>
<item><title>guid</title><guid>https://x/2</guid><dc:date>2026-06-09T10:00:00Z</dc:date></item>
<item><title>enclosure</title><guid>no</guid><enclosure url="http://x/3"/></item>
<item><title>nothing</title></item>
<item><link>http://x/untitled</link></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="http://search.yahoo.com/mrss/">
<entry><title>a</title><link rel="self" href="http://x/self"/><link href="http://x/alt"/><updated>2026-06-09T12:00:00Z</updated><published>2026-06-08T12:00:00Z</published><m:group><m:description>deep</m:description></m:group></entry>
<entry><title>b</title><link rel="self" href="http://x/only"/></entry></feed>"""
RDF = b"""<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel/><item><title>r</title><link>http://x/r</link></item></r:RDF>"""


def test_rss():
    got = feeds.raw_items(RSS)
    assert [g[1] for g in got] == ["http://x/1", "https://x/2", "http://x/3", "", "http://x/untitled"]
    assert got[1][2] == "2026-06-09T10:00:00Z"


def test_atom():
    a, b = feeds.raw_items(ATOM)
    assert a == ("a", "http://x/alt", "2026-06-09T12:00:00Z", "deep")
    assert b[1] == "http://x/only"


def test_rdf():
    assert feeds.raw_items(RDF) == [("r", "http://x/r", "", "")]


@pytest.mark.parametrize("raw", [b"<!DOCTYPE x><rss/>", b'<!DOCTYPE rss [<!ENTITY a "b">]><rss>&a;</rss>', b'<!DOCTYPE rss SYSTEM "http://x/y.dtd"><rss/>', b"<html/>", b"<rss>", b""])
def test_rejected(raw):
    with pytest.raises(feeds.Rejected):
        feeds.raw_items(raw)


def test_unpack():
    assert feeds.unpack(gzip.compress(b"x")) == b"x"
    for raw, limit in ((b"xxxx", 3), (gzip.compress(b"x" * 100), 50), (b"\x1f\x8bbroken", 99)):
        with pytest.raises(feeds.Rejected):
            feeds.unpack(raw, "", limit)


def resolver(*addresses):
    return lambda *a, **k: [(socket.AF_INET, 0, 0, "", (x, 80)) for x in addresses]


def unresolvable(*a, **k):
    raise socket.gaierror("no")


@pytest.mark.parametrize(
    ("url", "resolve"),
    [("file:///etc/passwd", resolver("8.8.8.8")), ("ftp://x/", resolver("8.8.8.8")), ("http://", resolver("8.8.8.8")), ("http://x/", resolver("10.0.0.1")), ("http://x/", resolver("8.8.8.8", "127.0.0.1")), ("http://x/", resolver("169.254.1.1")), ("http://x/", resolver("0.0.0.0")), ("http://x/", resolver("224.0.0.1")), ("http://x/", unresolvable)],
)
def test_urls_that_may_not_be_fetched(url, resolve):
    with pytest.raises(feeds.Rejected):
        feeds.check_url(url, resolve)


def test_public_url():
    assert feeds.check_url("https://x/", resolver("8.8.8.8")) == "https://x/"


def test_source(spark, tmp_path):
    for name, raw in (("good", RSS), ("bad", b"<rss>"), ("packed", gzip.compress(ATOM))):
        (tmp_path / f"{name}.xml").write_bytes(raw)
    rows = feeds.read_feeds(spark, feeds.feed_files(str(tmp_path)), local=True)
    got = {(r.source, r.title, r.url, r.summary) for r in feeds.feed_items(rows).collect()}
    assert ("good", "A & B", "http://x/1", "Hello you") in got
    assert ("packed", "a", "http://x/alt", "deep") in got
    assert len(got) == 5
    health = feeds.feed_health(rows).first()
    assert (health.loaded, health.failed) == (2, ["bad"])


def test_config(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text("{" + ",".join(f'"{g}": [{{"name": "{g}", "url": "http://{g}"}}]' for g in feeds.GROUPS) + "}")
    assert len(feeds.load_config(spark, str(path))) == len(feeds.GROUPS)
    path.write_text('{"security": []}')
    with pytest.raises(ValueError, match="pittsburgh"):
        feeds.load_config(spark, str(path))


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"url": "a"}\n\nnot json\n{"url": "b"}\n')
    assert sorted(r.url for r in feeds.read_json_lines(spark, str(tmp_path / "x.jsonl"), "url string").collect()) == ["a", "b"]


@pytest.mark.parametrize("url", ["file:///etc/hostname", "/etc/hostname", "FILE:///etc/hostname", "etc/hostname", "ftp://x/", "gopher://x/"])
def test_files_are_read_only_where_that_is_allowed(spark, url):
    with pytest.raises(feeds.Rejected):
        feeds.fetch(url, resolve=resolver("8.8.8.8"))
    health = feeds.feed_health(feeds.read_feeds(spark, [("security", "a", url)])).first()
    assert (health.loaded, health.failed) == (0, ["a"])


def test_redirects_are_checked_too():
    """A server on a public name that sends its readers to a private one."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Moved(BaseHTTPRequestHandler):
        def do_GET(self):
            body = b"" if self.path == "/moved" else b"here"
            self.send_response(302 if self.path == "/moved" else 200)
            self.send_header("Location", "http://private.test/secret")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Moved)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        answer = lambda host, *a, **k: resolver("10.0.0.1" if host == "private.test" else "8.8.8.8")()
        base = f"http://127.0.0.1:{server.server_port}"
        assert feeds.fetch(f"{base}/here", resolve=answer) == b"here"
        with pytest.raises(feeds.Rejected, match="private.test"):
            feeds.fetch(f"{base}/moved", resolve=answer)
    finally:
        server.shutdown()


def test_mapped_addresses():
    with pytest.raises(feeds.Rejected):
        feeds.check_url("http://x/", resolver("::ffff:127.0.0.1"))


def test_large_feed_in_pieces():
    raw = b"<rss><channel>" + b"".join(b"<item><title>t%d</title><link>http://x/%d</link></item>" % (k, k) for k in range(5000)) + b"</channel><channel><item><title>no</title></item></channel></rss>"
    got = feeds.raw_items(raw)
    assert len(got) == 5000 and got[4999] == ("t4999", "http://x/4999", "", "")


def test_payloads_over_the_limit_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "BODY_LIMIT", 20)
    (tmp_path / "a.json").write_text('{"a": 1}')
    (tmp_path / "b.json").write_text('{"a": "' + "x" * 30 + '"}')
    got = {r.path[-6:]: (r.body, r.error) for r in feeds.read_payloads(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ('{"a": 1}', None), "b.json": (None, "over 20 bytes")}
