import gzip
import hashlib
import io
import random
import struct
import zlib

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from briefspark.llm import matroska, urlfilter, warc, wavelet

PAGES = "page_id bigint, url string, html string, payload string, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], PAGES)


def test_warc_matches_sql(spark, sf_dir):
    same(warc.op3_warc(spark, sf_dir), connect(sf_dir), warc.OP3_SQL)


def written(spark, tmp_path, rows):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(warc.archive_records(pages(spark, rows)), path)
    return path


def test_warc_revisits_and_edges(spark, tmp_path):
    long = "<p>" + "é😀" * 60
    rows = [(5, "http://a/ \r\nEvil: 1", long), (3, "http://b", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (3, "u", long), (6, "u", "")]
    path = written(spark, tmp_path, rows)
    got = warc.read_archives(spark, path).collect()
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted(
        [("<urn:page:3>", "response", None)] * 2
        + [(f"<urn:page:{i}>", "revisit", "<urn:page:3>") for i in (5, 9, "none")]
        + [(f"<urn:page:{i}>", "response", None) for i in (1, 2, 4, 6)]
    )
    for r in got:
        assert r.payload_length == len((long if "short" not in str(r.payload) else "short").encode()) if r.payload else True
        assert "Evil" not in r.headers
        if r.record_type == "response":
            assert r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest()
    assert warc.read_archives(spark, path, payload=False).filter("payload is not null").count() == 0


def test_warc_filters_reach_the_reader(spark, tmp_path):
    path = written(spark, tmp_path, [(k, f"http://{k % 3}/", "x" * (200 + k)) for k in range(30)])
    found = warc.read_archives(spark, path).filter("record_type = 'response' and target_uri like 'http://1%' and record_id in ('<urn:page:1>', '<urn:page:2>', '<urn:page:4>')")
    assert sorted(r.record_id for r in found.collect()) == ["<urn:page:1>", "<urn:page:4>"]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "http://1"), GreaterThan(("payload_length",), 3)]))
    assert [type(f) for f in rest] == [GreaterThan] and len(reader.tests) == 2
    got = [row for p in reader.partitions() for row in reader.read(p)]
    assert len(got) == 10


def test_warc_empty(spark, tmp_path):
    path = written(spark, tmp_path, [])
    assert warc.read_archives(spark, path).count() == 0


def test_warc_skips_without_inflating():
    record = {"record_type": "response", "record_id": "<urn:page:1>", "payload": random.Random(1).randbytes(3_000_000), "payload_length": 3_000_000}
    data = warc.member(warc.record_bytes(record)) + warc.member(warc.record_bytes(record | {"record_id": "<urn:page:2>", "payload": b"x", "payload_length": 1}))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 2

    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    source = Counting(data)
    rows = list(warc.read_records(source, len(data), True, lambda r: r["record_id"].endswith("2>"), True))
    assert [r["payload"] for r in rows] == [b"x"] and source.got < 100_000


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_of_others(compressed):
    """Plain files, and members without skip lengths."""
    plain = [warc.record_bytes({"record_type": "response", "record_id": f"<{k}>", "payload": b"p" * k * 10_000, "payload_length": k * 10_000}) for k in range(4)]
    plain.insert(1, b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX: a\r\n  b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    data = b"".join(map(gzip.compress, plain) if compressed else plain)
    rows = list(warc.read_records(io.BytesIO(data), len(data), compressed, lambda r: True, True))
    assert [r["record_type"] for r in rows] == ["response", "warcinfo", "response", "response", "response"]
    assert rows[1]["headers"]["X"] == "a b" and rows[1]["payload"] == b"abc"
    assert [r["payload_length"] for r in rows] == [0, 3, 10_000, 20_000, 30_000]
    some = list(warc.read_records(io.BytesIO(data), len(data), compressed, lambda r: r["record_id"] == "<3>", True))
    assert len(some[0]["payload"]) == 30_000


# --- Matroska --------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 4096, 4097, 70_000, 200_001])
def test_matroska_round_trip(size):
    n, payload = matroska.padded("x" * size)
    data = matroska.mux(payload)
    media = matroska.parse(data)
    assert n == size and len(payload) % 64 == 0 and len(payload) >= max(64, size)
    assert b"".join(data[p.start : p.start + p.size] for p in media.packets) == payload
    assert media.doc_type == "matroska" and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    assert [p.timestamp_ms for p in media.packets] == [k * 64.0 for k in range(len(media.packets))]
    assert len(media.cues) == len(media.clusters)
    for (_, _, at), start in zip(media.cues, media.clusters, strict=True):
        assert data[at : at + 4] == b"\x1f\x43\xb6\x75" and at < start
    assert media.duration_ms == len(payload) / 8


def block(kind, body, track=1, offset=0, group=False):
    data = matroska.vint(track) + struct.pack(">h", offset) + bytes([kind << 1]) + body
    return matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, data)) if group else matroska.element(matroska.SIMPLE_BLOCK, data)


def test_matroska_of_others():
    """Xiph lacing, block groups, several tracks, void elements and unknown sizes."""
    xiph = bytes([2, 255, 45, 7]) + b"a" * 300 + b"b" * 7 + b"c" * 5
    void = matroska.element(0xEC, b"\0" * 9)
    cluster = lambda t, *b: matroska.uint(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + matroska.element(matroska.TIMESTAMP, matroska.uint(t)) + b"".join(b)
    body = void + matroska.element(matroska.INFO, matroska.element(matroska.TIMESTAMP_SCALE, matroska.uint(500_000))) + cluster(100, block(1, xiph), void) + cluster(300, block(0, b"z", 2, -4, True))
    data = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm")) + matroska.uint(matroska.SEGMENT) + b"\xff" + body
    media = matroska.parse(data)
    assert [p.size for p in media.packets] == [300, 7, 5, 1]
    assert [data[p.start] for p in media.packets] == list(b"abcz")
    assert [(p.track, p.cluster, p.timestamp_ms) for p in media.packets] == [(1, 0, 50.0)] * 3 + [(2, 1, 148.0)]
    assert media.packets[3].keyframe and media.doc_type == "webm"


@pytest.mark.parametrize("sizes", [[3, 3], [1, 2, 3], [200, 3, 70_000, 5], [5, 1], [300, 20]])
def test_lacing(sizes):
    kind, body = matroska.lace([bytes([k]) * n for k, n in enumerate(sizes)])
    got, at = matroska.lace_sizes(body, 0, len(body), kind)
    assert got == sizes and body[at] == 0


def test_broken_media():
    data = matroska.mux(b"x" * 640)
    for broken in (data[:-30], data[:100], b"\0" * 50):
        with pytest.raises((ValueError, IndexError)):
            matroska.parse(broken)


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 40, "clash"), (2, None, ""), (3, "é" * 40, ""), (None, "", ""), (5, "x" * 3_000_000, ""), (5, "x" * 3_000_000, "")], "doc_id bigint, text string, media string")
    stored = matroska.store_texts(docs)
    got = {r.doc_id: r for r in matroska.media_features(stored).collect()}
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    assert len(got) == 5
    assert got[1][1:] == got[3][1:] and got[2][1:] == got[None][1:]
    assert (got[1].n_bytes, got[1].payload_bytes, got[2].payload_bytes) == (80, 128, 64)
    assert got[1].payload_sha256 == hashlib.sha256("é".encode() * 40 + bytes(48)).hexdigest()
    assert got[1].tail_crc32 == zlib.crc32(("é".encode() * 40 + bytes(48))[-64:])
    assert all(got[i].media_sha256 == hashlib.sha256(data).hexdigest() for i, data in files.items())
    packets = matroska.packet_table(stored, "doc_id", "media")
    ranges = packets.filter("id = 1").orderBy("packet").collect()
    assert b"".join(files[1][p.byte_start : p.byte_start + p.byte_length] for p in ranges) == "é".encode() * 40 + bytes(48)
    assert packets.filter("id = 5").count() == 2 * -(-3_000_000 // matroska.FRAME)
    assert matroska.media_features(matroska.store_texts(docs.limit(0))).count() == 0


def test_matroska_query(spark, sf_dir):
    """All columns that can be told from a text alone, and the file by parsing it with the feature's counts."""
    import pyarrow.parquet as pq

    got = {r.doc_id: r for r in matroska.op6_matroska(spark, sf_dir).collect()}
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(rows)
    for d in rows:
        data = (d["text"] or "").encode()
        whole = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        file, r = matroska.mux(whole), got[d["doc_id"]]
        assert tuple(r)[1:7] == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(file), hashlib.sha256(file).hexdigest())
        samples = [b - 128 for b in whole]
        told = dict(x.split("=") for x in r.feature.split(";"))
        assert int(told["packets"]) == -(-len(whole) // matroska.FRAME)
        assert float(told["mean"]) == pytest.approx(sum(samples) / len(samples), abs=1e-4)
        assert int(told["turns"]) == sum((a >= 0) != (b >= 0) for a, b in zip(samples, samples[1:], strict=False))


# --- URL filters -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('urls')}/i"
    entries = [(*r, "rule") for r in urlfilter.RULES] + [(h, "/", "block", "list") for h in ("tracker.example.net", "ads.example.org")]
    urlfilter.build_index(spark.createDataFrame(entries, ENTRIES), folder, shards=3)
    return urlfilter.ShardedIndex(folder)


def test_url_filter_matches_sql(spark, sf_dir):
    same(urlfilter.op9_url_filter(spark, sf_dir), connect(sf_dir), urlfilter.OP9_SQL)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("x://com", "com", "", None, "allow"),
        ("http://a.net/fr", "a.net", "/fr", None, "allow"),
        ("http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
        ("http://ÄB.com?x=/en/", "Äb.com", "", None, "allow"),
        ("http://tracker.example.net/y", "tracker.example.net", "/y", None, "block"),
        ("http://x.tracker.example.net", "x.tracker.example.net", "", None, "block"),
        ("http://x.y/a://b/c", "x.y", "/a://b/c", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("http://..com./en/", "..com.", "/en/", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict, index):
    assert urlfilter.judge([url], index) == [(host, path, rule, verdict)]


def test_hosts_by_expression(spark):
    urls = ["http://Example.COM/en/x?q#f", "x://com", "http://ÄB.com?x=/en/", "http://x.y/a://b/c", "no scheme", "http://", "http://a?b/c", "a://b#c/d://e", "", None, "://", "h://u\nv/w"]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string").select("k", urlfilter.host_of(F.col("url")).alias("host"))
    assert {r.k: r.host for r in rows.collect()} == {k: urlfilter.split_url(u)[0] for k, u in enumerate(urls)}


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    import json

    import numpy as np

    monkeypatch.setattr(urlfilter, "digest", lambda keys: np.full(len(keys), 7, "<u8"))
    urlfilter.write_shard(f"{tmp_path}/only", [("a.com/", "block", "rule"), ("b.com/", "allow", "rule")])
    (tmp_path / "manifest.json").write_text(json.dumps({"shards": ["only"], "paths": [1]}))
    index = urlfilter.ShardedIndex(str(tmp_path))
    assert [urlfilter.judge([f"http://{h}/"], index)[0][2:] for h in ("a.com", "b.com", "c.com")] == [("a.com/", "block"), ("b.com/", "allow"), (None, "allow")]


ENTRIES = "host string, path string, verdict string, kind string"


def test_sharded_index(spark, tmp_path):
    entries = spark.createDataFrame([(f"h{k}.com", f"/{k % 7}/", "block", "rule") for k in range(500)] * 2 + [(None, "/", "block", "rule"), ("", "/", "block", "rule")], ENTRIES)
    folder = f"file://{tmp_path}/index"
    assert urlfilter.build_index(entries, folder, shards=5) == 5
    index = urlfilter.ShardedIndex(folder)
    rows = spark.createDataFrame([(k, f"http://x.h{k}.com/{k % 7}/y", "clash") for k in range(600)], "page_id bigint, url string, host string")
    got = urlfilter.filter_urls(rows, folder).filter("verdict = 'block'")
    assert got.count() == 500
    assert urlfilter.filter_urls(rows.limit(0), folder).count() == 0
    assert sum(f.meta["entries"] for f in (urlfilter.DigestIndex(f"{folder}/{n}", {}) for n in index.names)) == 500
    assert not index.open
    list(index.find([b"h1.com/1/"]))
    assert len(index.open) == 1  # only the shard that the key's digest names


def test_the_list_blocks_some_pages(spark):
    """The query's list has many thousands of hosts, in several shards, and some of ``pages`` are below them."""
    got = urlfilter.op9_url_filter(spark, "/root/testdata/sf0.01").filter("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}
    assert urlfilter.MADE_UP > 2 * urlfilter.SHARD_ENTRIES


def test_empty_index(spark, tmp_path):
    urlfilter.build_index(spark.createDataFrame([], ENTRIES), f"file://{tmp_path}/i")
    rows = spark.createDataFrame([(1, "http://a/")], "page_id bigint, url string")
    assert urlfilter.filter_urls(rows, f"file://{tmp_path}/i").first().verdict == "allow"


# --- wavelet files ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet(tmp_path, n):
    import numpy as np

    tokens = np.random.default_rng(n).integers(0, 60, n).astype("<u2") * 997 % 50_000
    tokens = tokens.astype("<u2")
    path = tmp_path / "x.bsw"
    with path.open("wb") as f:
        wavelet.write_file(f, [None, 7], [n // 3, n - n // 3], tokens, 16)
    w = wavelet.WaveletFile(str(path))
    assert (w.all_tokens() == tokens).all()
    assert [(i, s, t.tolist()) for i, s, t in w.documents()] == [(None, 0, tokens[: n // 3].tolist()), (7, n // 3, tokens[n // 3 :].tolist())]
    for i in {0, n // 2, n - 1} & set(range(n)):
        assert w.access(i) == tokens[i]
    for token in {*tokens[:5].tolist(), 65_535}:
        places = np.flatnonzero(tokens == token)
        assert w.rank(token, n) == len(places) and w.rank(token, n // 2) == (places < n // 2).sum()
        assert [w.select(token, k) for k in range(len(places))] == places.tolist()
        assert w.select(token, len(places)) == -1
    with pytest.raises(IndexError):
        w.access(n)
