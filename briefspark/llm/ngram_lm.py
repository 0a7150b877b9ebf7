"""Stupid-backoff scores of every document by the n-gram counts of the whole corpus.

Tables, and how they are joined:

* Documents are cut into blocks, files in the shared folder that everything after reads. A block's
  n-grams (orders 0 to 3; the one of order 0 counts all words) are 64-bit hashes, distinct and
  ascending with their counts: the exploded n-grams, summed up before anything is shuffled, so a
  frequent word is one entry a block.
* The entries are dealt by hash, summed up (the count tables), and joined back to the blocks that
  asked for them.
* Totals come together by block, in the order of its hashes; the scores of its words are looked
  up there and summed per document.

Up to PACKED_BYTES of text, entries that go from one block to one partition travel as one row of
compressed byte planes of differences between ascending hashes, 5 to 6 bytes an entry. Such rows
grow with the square of the corpus while they get shorter; beyond, every entry is a row of its
own, counted by groupBy and joined by Spark. Both give the same scores.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.shared import file_system, materialize, new_folder, table

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES, PARTITION_BYTES = 10 << 20, 8 << 20
#: At this size a packed row has some 400 entries.
PACKED_BYTES = 64 << 30
SEED = 7
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _extend(history: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams one word longer."""
    return _mix(history * _MIX[0] + words)


TOTAL = _mix(np.array([1], "<u8"))[0]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: A-Z lowered, split at ASCII white space."""
    import xxhash

    words = (text or "").encode().lower().split()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, SEED) for w in words), "<u8", len(words))


class BlockGrams:
    """The n-grams of some texts: per order an array over all words, and which of them begin within a text."""

    def __init__(self, texts: list[str | None], with_places: bool = False) -> None:
        each = [word_hashes(t) for t in texts]
        self.lengths = np.array([len(w) for w in each], np.int64)
        words = np.concatenate(each) if each else np.zeros(0, "<u8")
        del each
        starts = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        place = np.arange(len(words)) - starts  # of a word in its text
        grams = [_mix(words)]
        for n in range(1, ORDER):
            longer = np.zeros_like(words)
            longer[1:] = _extend(grams[-1][:-1], words[1:])
            grams.append(longer)
        self.valid = [place >= n for n in range(ORDER)]
        found = np.concatenate([g[v] for g, v in zip(grams, self.valid, strict=True)])
        del grams, place, starts
        #: With places, per order where each word's n-gram stands in ``keys``; zero where none begins.
        self.places: list[np.ndarray] = []
        if with_places:
            order = np.argsort(found)
            found = found[order]
        else:
            found.sort()
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        self.keys, self.counts = found[first], np.diff(np.r_[first, len(found)])
        at = int(np.searchsorted(self.keys, TOTAL))
        if with_places:
            spot = np.empty(len(found), np.int64)
            spot[order] = np.repeat(np.arange(len(first)), self.counts)
            spot += spot >= at
            for v, part in zip(self.valid, np.split(spot, np.cumsum([v.sum() for v in self.valid])[:-1]), strict=True):
                self.places.append(np.zeros(len(words), np.int64))
                self.places[-1][v] = part
        self.keys = np.insert(self.keys, at, TOTAL)
        self.counts = np.insert(self.counts, at, len(words))

    def _own(self, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How often the n-grams at ``places`` of some words are in these words' own texts."""
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)[words]
        key = text * len(self.keys) + places
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        out = np.empty(len(key), np.int64)
        many = np.diff(np.r_[first, len(key)])
        out[order] = np.repeat(many, many)
        return out

    def _sums(self, count: list[np.ndarray], everything: np.ndarray | float) -> np.ndarray:
        """Sum of the words' natural log scores per text, from the counts of their n-grams by order."""
        score = count[0] / everything
        for k in range(1, ORDER):
            history = np.r_[0, count[k - 1][:-1]]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(count[k] > 0, count[k] / history, np.where(self.valid[k], BACKOFF, 1.0) * score)
        out, some = np.zeros(len(self.lengths)), self.lengths > 0
        out[some] = np.add.reduceat(np.log(score), (np.cumsum(self.lengths) - self.lengths)[some])
        return out

    def scores(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sum of its words' log scores, by all texts and by all others; ``totals`` are the corpus' counts in the order of ``keys``."""
        if not self.lengths.any():
            return np.zeros(len(self.lengths)), np.zeros(len(self.lengths))
        whole, others = [], []
        for k in range(ORDER):
            places, valid = self.places[k], self.valid[k]
            whole.append(np.where(valid, totals[places], 0))
            own, many = valid.astype(np.int64), whole[-1] > 1  # what occurs once occurs here
            own[many] = self._own(places[many], many)
            others.append(whole[-1] - own)
        everything = int(totals[np.searchsorted(self.keys, TOTAL)])
        floor = np.maximum(others[0], 1)
        rest = np.maximum(everything - np.repeat(self.lengths, self.lengths), 1)
        return self._sums(whole, float(everything)), self._sums([floor, *others[1:]], rest)


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as their lowest bytes, then their second ones, and so on: planes of zeros compress away."""
    import pyarrow as pa

    data = values.astype(f"<u{width}").view("u1").reshape(-1, width).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def from_planes(data: bytes, width: int) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(data[:4], "little")
    plain = pa.decompress(data[4:], decompressed_size=n * width, codec="zstd")
    return np.frombuffer(plain, "u1").reshape(width, n).T.copy().view(f"<u{width}").reshape(-1)


def ascending(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)), 8)


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, 8), dtype=np.uint64)


# --- operators -------------------------------------------------------------------------


def _batches(rows: list[tuple], kinds: dict[str, str], size: int) -> Iterator:
    import pyarrow as pa

    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows[at : at + size], strict=True), kinds.values(), strict=True)], names=list(kinds))


def _write_blocks(folder: str):
    """Map documents (id, text) to the names of the files that hold them; each attempt writes files of its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        ids: list[int | None] = []
        texts: list[str | None] = []

        def write():
            name = uuid.uuid4().hex
            data = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
            with system.open_output_stream(f"{place}/{name}") as out, pa.ipc.new_file(out, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_table(data)
            return _batches([(name,)], {"block": "string"}, 1)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids += part.column(0).to_pylist()
                texts += (new := part.column(1).to_pylist())
                size += sum(len(t or "") for t in new)
                if size >= BLOCK_BYTES:
                    yield from write()
                    ids, texts, size = [], [], 0
        if ids:
            yield from write()

    return run


def _block(folder: str, name: str, with_places: bool = False) -> tuple:
    import pyarrow as pa

    system, place = file_system(folder)
    with system.open_input_file(f"{place}/{name}") as source:
        data = pa.ipc.open_file(source).read_all()
    return data["id"].combine_chunks(), BlockGrams(data["text"].to_pylist(), with_places)


def _names(batches: Iterator) -> Iterator[str]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _requests(folder: str, bits: int):
    """Map names of blocks to rows (part, block, entries): what each block asks of each partition."""

    def run(batches: Iterator) -> Iterator:
        for name in _names(batches):
            grams = _block(folder, name)[1]
            parts = (grams.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams.keys), np.int64)
            used, first = np.unique(parts, return_index=True)
            ends = [*first[1:], len(parts)]
            rows = [(int(p), name, ascending(grams.keys[a:b]), planes(grams.counts[a:b], 4)) for p, a, b in zip(used, first, ends, strict=True)]
            yield from _batches(rows, {"part": "int", "block": "string", "grams": "binary", "counts": "binary"}, 256)

    return run


def _entries(folder: str):
    """Map names of blocks to rows (block, gram, count); signed hashes in the order of the unsigned ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for name in _names(batches):
            grams = _block(folder, name)[1]
            signed = (grams.keys ^ np.uint64(1 << 63)).view("<i8")
            for at in range(0, len(signed), 100_000):
                part = signed[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), pa.array(grams.counts[at : at + 100_000].astype("<i8"))], names=["block", "gram", "count"])

    return run


def _packed_totals(batches: Iterator) -> Iterator:
    """Rows (block, gram, total), in order, as one row (block, part, totals) for each stretch of a block."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        totals = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        yield from _batches([(names[a], 0, planes(totals[a:b], 8)) for a, b in itertools.pairwise(cuts) if b > a], {"block": "string", "part": "int", "totals": "binary"}, 1000)


def _replies(batches: Iterator) -> Iterator:
    """Sum up a partition's counts and give each of its rows the totals of its entries."""
    asked = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if not asked:
        return
    grams = [from_ascending(r[2]) for r in asked]
    order = np.argsort(keys := np.concatenate(grams), kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    totals = np.add.reduceat(np.concatenate([from_planes(r[3], 4) for r in asked])[order], first, dtype=np.int64)
    keys = keys[first]
    del order, first
    for at in range(0, len(asked), 64):
        rows = [(r[1], r[0], planes(totals[np.searchsorted(keys, g)], 8)) for r, g in zip(asked[at : at + 64], grams[at : at + 64], strict=True)]
        yield from _batches(rows, {"block": "string", "part": "int", "totals": "binary"}, 64)


def _scores(folder: str):
    """Read each block's text again and score it by the totals that came together."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def score(name: str, replies: list[bytes]):
            ids, grams = _block(folder, name, True)
            totals = np.concatenate([from_planes(r, 8) for r in replies])
            if len(totals) != len(grams.keys):
                raise ValueError(f"{len(totals)} totals for {len(grams.keys)} n-grams of block {name}")
            whole, others = grams.scores(totals)
            some = grams.lengths > 0
            mean = np.divide(whole, grams.lengths, out=np.zeros_like(whole), where=some)
            return pa.RecordBatch.from_arrays([ids, pa.array(grams.lengths), pa.array(whole), pa.array(mean, mask=~some), pa.array(others)], names=[c.split()[0] for c in SCORES.split(", ")])

        name, replies = None, []
        for batch in batches:
            for block, _, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != name:
                    if replies:
                        yield score(name, replies)
                    name, replies = block, []
                replies.append(totals)
        if replies:
            yield score(name, replies)

    return run


SCORES = "doc_id bigint, n_words bigint, log_score double, mean_log_score double, others_log_score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", packed_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score (sum over words of the natural log of the score), its mean per word, and others_log_score.

    A word's score is its trigram's count by that of the two words before it; if the trigram
    doesn't occur, 0.4 times the same for the bigram, and so on down to its share of all words. A
    text's first words have shorter histories at no loss. In its own corpus every trigram occurs,
    so others_log_score is the same by the counts of all other rows; there a word that no other
    row has counts as if it occurred once. Null, empty and blank texts have no words, sums 0 and a
    null mean. Repeated rows are counted and scored like others. ``docs`` may come from anywhere:
    its rows are written once, and read from there.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    folder = new_folder(spark, "blocks")
    names = materialize(rows.mapInArrow(_write_blocks(folder), "block string"), "block-names")
    blocks = names.count()
    total = blocks * BLOCK_BYTES
    dealt = names.repartition(max(1, min(blocks, 20_000)))
    if total <= (PACKED_BYTES if packed_bytes is None else packed_bytes):
        bits = max(0, (total // PARTITION_BYTES).bit_length())
        asked = dealt.mapInArrow(_requests(folder, bits), "part int, block string, grams binary, counts binary")
        replies = asked.repartitionById(1 << bits, F.col("part")).mapInArrow(_replies, "block string, part int, totals binary")
        together = replies.repartition("block").sortWithinPartitions("block", "part")
    else:
        entries = dealt.mapInArrow(_entries(folder), "block string, gram bigint, count bigint")
        counts = entries.groupBy("gram").agg(F.sum("count").alias("total"))
        replies = entries.select("block", "gram").join(counts.hint("merge"), "gram").select("block", "gram", "total")
        ordered = replies.repartition("block").sortWithinPartitions("block", "gram")
        together = ordered.mapInArrow(_packed_totals, "block string, part int, totals binary")
    return together.mapInArrow(_scores(folder), SCORES)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score", "others_log_score")})


_GRAMS = {1: "w", 2: "v, w", 3: "u, v, w"}
_COUNTS = ",\n".join(f"c{n} AS (SELECT {g}, count(*) AS c FROM g WHERE {g.split(',')[0]} IS NOT NULL GROUP BY ALL),\no{n} AS (SELECT r, {g}, count(*) AS c FROM g WHERE {g.split(',')[0]} IS NOT NULL GROUP BY ALL)" for n, g in _GRAMS.items())
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT count(*) AS n FROM t),
{_COUNTS},
a AS (SELECT g.r, g.u, g.v, c1.c AS a1, h1.c AS b1, c2.c AS a2, h2.c AS b2, c3.c AS a3, n.n AS n,
    greatest(c1.c - o1.c, 1) AS p1, greatest(h1.c - oh1.c, 1) AS q1, c2.c - o2.c AS p2, h2.c - oh2.c AS q2, c3.c - o3.c AS p3, greatest(n.n - len(d.ws), 1) AS m
  FROM g CROSS JOIN n JOIN d ON g.r = d.r JOIN c1 ON g.w = c1.w JOIN o1 ON g.r = o1.r AND g.w = o1.w
  LEFT JOIN c2 ON g.v = c2.v AND g.w = c2.w LEFT JOIN o2 ON g.r = o2.r AND g.v = o2.v AND g.w = o2.w
  LEFT JOIN c1 h1 ON g.v = h1.w LEFT JOIN o1 oh1 ON g.r = oh1.r AND g.v = oh1.w
  LEFT JOIN c3 ON g.u = c3.u AND g.v = c3.v AND g.w = c3.w LEFT JOIN o3 ON g.r = o3.r AND g.u = o3.u AND g.v = o3.v AND g.w = o3.w
  LEFT JOIN c2 h2 ON g.u = h2.v AND g.v = h2.w LEFT JOIN o2 oh2 ON g.r = oh2.r AND g.u = oh2.v AND g.v = oh2.w),
s AS (SELECT r,
    CASE WHEN a3 > 0 THEN a3 / b2 WHEN a2 > 0 THEN (CASE WHEN u IS NULL THEN 1 ELSE {BACKOFF} END) * a2 / b1
      ELSE (CASE WHEN v IS NULL THEN 1 WHEN u IS NULL THEN {BACKOFF} ELSE {BACKOFF * BACKOFF} END) * a1 / n END AS x,
    CASE WHEN p3 > 0 THEN p3 / q2 WHEN p2 > 0 THEN (CASE WHEN u IS NULL THEN 1 ELSE {BACKOFF} END) * p2 / q1
      ELSE (CASE WHEN v IS NULL THEN 1 WHEN u IS NULL THEN {BACKOFF} ELSE {BACKOFF * BACKOFF} END) * p1 / m END AS y FROM a),
z AS (SELECT r, sum(ln(x)) AS x, sum(ln(y)) AS y FROM s GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 6) AS log_score, CASE WHEN len(ws) > 0 THEN round(x / len(ws), 6) END AS mean_log_score, round(coalesce(y, 0), 6) AS others_log_score
FROM d LEFT JOIN z USING (r)
"""
