"""Token ids in wavelet matrices: one file per shard of ascending document ids.

File, little-endian: magic, length of the header and the header (JSON), then sections at
multiples of 8 bytes: document ids (int64), where each document ends (int64), and for every bit
from the highest its plane (bits, lowest first) and the ones before each block of 512 bits
(int64). On each level zeros go before ones, in order; the header has the zeros of each level.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.shared import file_system, local_copy, new_folder, sums_before, table
from briefspark.llm.tokens import public_path, word_encoder

MAGIC = b"BSWAVE01"
BLOCK = 512
SHARD_BYTES = 32 << 20


def build_planes(symbols: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """(packed plane, zeros) of each level."""
    for level in range(bits):
        ones = (symbols & symbols.dtype.type(1 << bits - 1 - level)) != 0
        low = symbols[~ones]
        yield np.packbits(ones, bitorder="little"), len(low)
        symbols = np.concatenate([low, symbols[ones]])


def ones_before(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane."""
    whole = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), "u1")
    whole[: len(plane)] = plane
    counts = np.bitwise_count(whole.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(counts)]).astype("<i8")


def id_bits(path: str, end_id: int) -> int:
    """Bits that hold every id of a vocabulary file and the end id."""
    from tokenizers import Tokenizer

    return max(1, max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()).bit_length())


def write_file(out, doc_ids: list[int | None], lengths: list[int], symbols: np.ndarray, bits: int) -> None:
    sections = [np.array([0 if i is None else i for i in doc_ids], "<i8"), np.cumsum(np.array(lengths, "<i8"), dtype="<i8")]
    zeros = []
    for plane, z in build_planes(symbols, bits):
        sections += [plane, ones_before(plane)]
        zeros.append(z)
    header = {"tokens": len(symbols), "docs": len(doc_ids), "null_ids": sum(i is None for i in doc_ids), "bits": bits, "zeros": zeros, "sections": [s.nbytes for s in sections]}
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    out.write(MAGIC + len(head).to_bytes(8, "little") + head)
    for s in sections:
        out.write(s.tobytes() + bytes(-s.nbytes % 8))


class WaveletFile:
    """Access, counting and lookup in one memory-mapped file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, "u1", "r")
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path} isn't a wavelet file")
        size = int.from_bytes(data[8:16].tobytes(), "little")
        self.header = json.loads(data[16 : 16 + size].tobytes())
        at, parts = 16 + size, []
        for n in self.header["sections"]:
            parts.append(data[at : at + n])
            at += n + -n % 8
        self.tokens, self.bits, self.zeros = self.header["tokens"], self.header["bits"], self.header["zeros"]
        self.doc_ids, self.ends = parts[0].view("<i8"), parts[1].view("<i8")
        self.planes, self.blocks = parts[2::2], [p.view("<i8") for p in parts[3::2]]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        block = i // BLOCK
        part = np.unpackbits(self.planes[level][block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(self.blocks[level][block]) + int(part.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        """The places on the last level of ``token`` among the first ``end`` tokens."""
        low = 0
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, end)
            low, end = (self.zeros[level] + a, self.zeros[level] + b) if token >> self.bits - 1 - level & 1 else (low - a, end - b)
        return low, end

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` is among the first ``end`` tokens."""
        low, high = self._interval(token, end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence, from 0; -1 if there are fewer."""
        low, high = self._interval(token, self.tokens)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in reversed(range(self.bits)):
            one = token >> self.bits - 1 - level & 1
            k = at - self.zeros[level] if one else at
            low, high = 0, self.tokens
            while high - low > 1:  # the last place with at most k such bits before it
                mid = (low + high) // 2
                ones = self._ones(level, mid)
                if (ones if one else mid - ones) <= k:
                    low = mid
                else:
                    high = mid
            at = low
        return at

    def all_tokens(self) -> np.ndarray:
        """Every token in order, by undoing the levels from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        symbols = np.zeros(self.tokens, kind)
        for level in reversed(range(self.bits)):
            ones = np.unpackbits(self.planes[level], count=self.tokens, bitorder="little").view(bool)
            above = np.empty_like(symbols)
            z = self.zeros[level]
            above[~ones] = symbols[:z]
            above[ones] = symbols[z:] | kind(1 << self.bits - 1 - level)
            symbols = above
        return symbols

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first place, tokens) of each document."""
        tokens, start = self.all_tokens(), 0
        for k, end in enumerate(self.ends.tolist()):
            yield None if k < self.header["null_ids"] else int(self.doc_ids[k]), start, tokens[start:end]
            start = end


# --- operators -------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """Encode every text, deal documents by ranges of id and write one file per range; returns how many, 0 for an empty table.

    Null ids go first; rows that share an id stand together, ordered by their tokens. A null text
    is empty: its end id alone. Ranges come from approximate quantiles over all ids, so a shard
    holds about ``shard_bytes`` of text. Planes are as many as the vocabulary's ids need bits, and
    ids of over 16 bits travel as 32. Each attempt writes under a name of its own and then
    renames, so a repeated task leaves the same file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1), F.lit(0))).first()[0]
    if not total:
        return 0
    shards = -(-total // shard_bytes)
    bounds: list[int] = []
    if shards > 1:
        bounds = rows.agg(F.percentile_approx("id", [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0] or []

    bits = id_bits(path, end_id)
    kind = np.dtype("<u2" if bits <= 16 else "<u4")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, ends = word_encoder(path), np.array(bounds, np.int64)
        last = np.array([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                data = [np.frombuffer(encoder.encode(t or ""), "<u4").astype(kind).tobytes() + last for t in part.column(1).to_pylist()]
                places = [0 if i is None else int(np.searchsorted(ends, i, "left")) for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), part.column(0), pa.array(data, pa.binary())], names=["shard", "id", "tokens"])

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        ids: list[int | None] = []
        blobs: list[bytes] = []
        for batch in batches:
            ids += batch.column(1).to_pylist()
            blobs += batch.column(2).to_pylist()
        shard = TaskContext.get().partitionId()
        lengths = [len(b) // kind.itemsize for b in blobs]
        symbols = np.frombuffer(b"".join(blobs), kind)
        blobs.clear()
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        attempt = f"{place}/_{uuid.uuid4().hex}"
        with system.open_output_stream(attempt) as out:
            write_file(out, ids, lengths, symbols, bits)
        system.move(attempt, f"{place}/shard-{shard:06d}.bsw")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "tokens": pa.array([sum(lengths)], pa.int64())})

    dealt = rows.mapInArrow(encode, "shard int, id bigint, tokens binary").repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tokens")
    dealt.mapInArrow(write, "shard bigint, tokens bigint").write.parquet(f"{folder}/manifest")
    return shards


def read_shards(spark: SparkSession, folder: str, shards: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, and nothing else.

    Each shard's row of the manifest brings the ids before it along, and each shard is a task.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache: dict[str, str] = {}
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(i, start + at, len(t), zlib.crc32(t.astype("<u4"))) for i, at, t in WaveletFile(local_copy(f"{folder}/shard-{shard:06d}.bsw", cache)).documents()]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not shards:
        return spark.createDataFrame([], schema)
    manifest = spark.read.schema("shard bigint, tokens bigint").parquet(f"{folder}/manifest")
    starts = sums_before(manifest, [], "shard", "tokens", "start")
    return starts.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(read, schema)


def op8_wavelet(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = new_folder(spark, "wavelet")
    shards = write_shards(table(spark, sf_dir, "documents"), folder, path or public_path("word_bpe_49k.json"))
    return read_shards(spark, folder, shards)
