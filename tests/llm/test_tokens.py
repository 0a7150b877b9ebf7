import collections
import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest

from briefspark.llm import bpe, packing, tokens, wavelet

BYTES, WORDS = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  ", "a \n b", "\n\nfoo\n\n bar \n", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c  <|endoftext|>", "-" * 3000, " " * 3000, "a" * 5000, "ΑΣ ΑΣΑ", "don't I'LL we're'S", "zażółć", "İstanbul ǅ ŉ", "日本語 テキスト", "👍🏽‍ x", "e\u0301 é", "\x1c\x1d \x85", "ſK", "a\u2003b", "\ufeffx"]


@cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def samples(n=1500, seed=1):
    pick = random.Random(seed)
    letters = list("aaeehtt  \n\t.,'sSÄßéÉΣςσİıſK1²³½_-<|>endoftext\r\x1c\x85\xa0\u2003日😀\u0301\u200d\x00")
    return ODD + ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() + samples()


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoders_equal_the_library(texts):
    prefix = bpe.prefix_encoder(BYTES)[1]
    fast, words = tokens.byte_encoder(BYTES), tokens.word_encoder(WORDS)
    for path, encoders in ((BYTES, (prefix, fast)), (WORDS, (words,))):
        want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
        for encoder in encoders:
            assert [ids(encoder.encode(t)) for t in texts] == want


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 600_000 + "b", "x" * 300_000, "word, " * 100_000])
def test_very_long_texts(text):
    want = library(BYTES).encode(text, add_special_tokens=False).ids
    assert ids(tokens.byte_encoder(BYTES).encode(text)) == want
    assert ids(bpe.prefix_encoder(BYTES)[1].encode(text)) == want
    assert ids(tokens.word_encoder(WORDS).encode(text)) == library(WORDS).encode(text, add_special_tokens=False).ids


def test_decoding_equals_the_library(texts):
    lib, own = library(BYTES), bpe.prefix_encoder(BYTES)[0]
    pick = random.Random(2)
    for row in [lib.encode(t, add_special_tokens=False).ids for t in texts[:300]] + [[pick.randrange(50257) for _ in range(9)] for _ in range(300)]:
        assert own.decode(row) == lib.decode(row, skip_special_tokens=False)


def test_pairs_against_merging():
    """Two tokens may stand together exactly if the encoding of their bytes is these two."""
    own, lib, pick = bpe.prefix_encoder(BYTES)[0], library(BYTES), random.Random(3)
    letters = [i for t, i in own.ids.items() if t.isalpha() and t.isascii()]
    for _ in range(3000):
        a, b = pick.choice(letters), pick.choice(letters)
        text = (own.bytes[a] + own.bytes[b]).decode()
        assert own.beside(a << 32 | b) == (lib.encode(text, add_special_tokens=False).ids == [a, b])


def test_caches_start_anew(monkeypatch):
    encoder = tokens.SpacedEncoder(tokens.byte_encoder(BYTES).encode_text)
    encoder.rest.entries = 3
    text = "one two three four five six seven eight one two"
    assert ids(encoder.encode(text)) == library(BYTES).encode(text).ids and len(encoder.rest) <= 3


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id bigint, text string, sequence_id string, length int")


ROWS = [(1, "hello world"), (2, None), (3, ""), (3, "again"), (3, "again"), (None, "no id"), (4, "word " * 3000), (5, "x"), (6, "long " * 900)]


def test_bpe_table(spark):
    got = bpe.encode_texts(documents(spark, ROWS), BYTES, keep_ids=True).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t in ROWS)
    empty = next(r for r in got if r.doc_id == 2)
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    one = next(r for r in got if r.doc_id == 1)
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, one.ids)).encode()).hexdigest()
    assert bpe.encode_texts(documents(spark, []), BYTES).count() == 0


def test_bpe_query(spark, sf_dir):
    import pyarrow.parquet as pq

    want = {r["doc_id"]: library(BYTES).encode(r["text"], add_special_tokens=False).ids for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    for r in bpe.op2_bpe(spark, sf_dir).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library(BYTES).decode(want[r.doc_id], skip_special_tokens=False).encode()).hexdigest()


def check_packing(pieces, want, room=1024):
    """Every id of every document in exactly one piece, sequences without gaps and within ``room``."""
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
    found = collections.Counter()
    for (doc, n), rows in by_doc.items():
        starts = collections.Counter((p.start, p.length) for p in rows)
        copies = {c for c in starts.values()}
        assert sum(p.length for p in rows) % n == 0
        assert min(copies) >= 1
        found[doc, n] += sum(p.length for p in rows) // n
    assert found == collections.Counter((d, len(t)) for d, t in want)
    tokens_of = collections.defaultdict(set)
    for d, t in want:
        for p in by_doc[d, len(t)]:
            tokens_of[d, len(t), p.start, p.length].add(zlib.crc32(np.array(t[p.start : p.start + p.length], "<u4").tobytes()))
    assert all(p.ids_crc32 in tokens_of[p.doc_id, p.doc_tokens, p.start, p.length] for p in pieces)
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at and length > 0
            at += length
        assert at <= room
    return sequences


def test_packing_edges(spark):
    want = [(i, library(BYTES).encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS]
    check_packing(packing.pack_documents(documents(spark, ROWS)).collect(), want)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_packing_query(spark, sf_dir):
    import pyarrow.parquet as pq

    want = [(r["doc_id"], library(BYTES).encode(r["text"], add_special_tokens=False).ids + [0]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    sequences = check_packing(packing.op4_packing(spark, sf_dir).collect(), want)
    total = sum(len(t) for _, t in want)
    assert len(sequences) * 1024 < 1.05 * total + 1024


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_once(seed):
    pick = random.Random(seed)
    room = pick.choice([8, 100, 1024])
    histogram = {pick.randrange(1, room + 1): pick.choice([1, 2, 50, 10_000]) for _ in range(pick.choice([1, 5, 60]))}
    fill = collections.Counter()
    ranks = collections.defaultdict(list)
    for length, first, count, pack, offset in packing.plan_packs(histogram, room):
        ranks[length].append((first, count))
        for k in range(count):
            assert fill[pack + k] == offset
            fill[pack + k] += length
    assert max(fill.values(), default=0) <= room and set(fill) == set(range(len(fill)))
    for length, n in histogram.items():
        at = 0
        for first, count in sorted(ranks[length]):
            assert first == at
            at += count
        assert at == n


def test_one_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 50)
    rows = [(k, 0, 300, k, 300) for k in range(1000)] + [(k, 0, k % 200 + 1, k, k % 200 + 1) for k in range(1000, 1500)]
    from briefspark.llm.shared import materialize

    got = packing.place(materialize(spark.createDataFrame(rows, packing.PIECES), "hot")).collect()
    assert len(got) == 1500
    sequences = collections.defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for r in sequences.values():
        at = 0
        for offset, length in sorted(r):
            assert offset == at
            at += length
        assert at <= 1024


def test_sums_before_in_two_levels(spark):
    from briefspark.llm.shared import sums_before

    rows = spark.createDataFrame([(k % 3, k // 3, k) for k in range(100)], "length int, at bigint, n bigint")
    got = {(r.length, r.at): r.s for r in sums_before(rows, ["length"], "at", "n", "s", together=4).collect()}
    assert got == {(k % 3, k // 3): sum(range(k % 3, k, 3)) for k in range(100)}
    alone = {r.n: r.s for r in sums_before(spark.range(10).selectExpr("id as n", "id as v"), [], "n", "v", "s", together=3).collect()}
    assert alone == {k: k * (k - 1) // 2 for k in range(10)}


def test_wavelet_query(spark, sf_dir):
    import pyarrow.parquet as pq

    rows = sorted(pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    want, at = [], 0
    for r in rows:
        t = library(WORDS).encode(r["text"], add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        at += len(t)
    assert sorted(tuple(r) for r in wavelet.op8_wavelet(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("shard_bytes", [3000, 1 << 25])
def test_wavelet_shards(spark, tmp_path, shard_bytes):
    folder = f"file://{tmp_path}/w"
    n = wavelet.write_shards(documents(spark, ROWS), folder, WORDS, shard_bytes=shard_bytes)
    got = sorted((tuple(r) for r in wavelet.read_shards(spark, folder, n).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([i for i, _ in ROWS], key=lambda i: -1 if i is None else i)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()][:-1]
    assert next(r for r in got if r[0] == 2)[2:] == (1, zlib.crc32(np.array([1], "<u4").tobytes()))


def test_wavelet_ids_beyond_16_bits(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    n = wavelet.write_shards(documents(spark, [(1, "one two"), (2, None)]), folder, WORDS, end_id=70_000)
    got = sorted(tuple(r) for r in wavelet.read_shards(spark, folder, n).collect())
    ids = [library(WORDS).encode("one two", add_special_tokens=False).ids + [70_000], [70_000]]
    assert got == [(1, 0, len(ids[0]), zlib.crc32(np.array(ids[0], "<u4").tobytes())), (2, len(ids[0]), 1, zlib.crc32(np.array(ids[1], "<u4").tobytes()))]


def test_wavelet_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    assert wavelet.read_shards(spark, folder, wavelet.write_shards(documents(spark, []), folder, WORDS)).count() == 0
