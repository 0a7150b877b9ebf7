"""Matroska: write 8-bit samples as laced blocks in clusters, parse files into packet tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.shared import new_folder, table

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that an open-ended cluster or segment ends at.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

SAMPLE_RATE, FRAME, FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 8000, 512, 8, 16
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


# --- writing ---------------------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; the value of all ones is kept for "unknown"."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def uint(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return uint(ident) + vint(len(body)) + body


def signed_vint(value: int) -> bytes:
    """A difference of lace sizes: a vint around the middle of its range."""
    width = next(n for n in range(1, 9) if abs(value) < (1 << 7 * n - 1) - 1)
    return vint(value + (1 << 7 * width - 1) - 1, width)


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing kind and the data of a block: fixed for equal frames, EBML otherwise."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return FIXED, head + b"".join(frames)
    head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return EBML_LACING, head + b"".join(frames)


def mux(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A file with one PCM track of 8-bit samples; nothing in it depends on clock or chance."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = lambda samples: samples * 1000 // rate
    head = element(EBML, element(EBML_VERSION, b"\1"), element(EBML_READ_VERSION, b"\1"), element(MAX_ID, b"\4"), element(MAX_SIZE, b"\x08"), element(DOC_TYPE, b"matroska"), element(DOC_VERSION, b"\4"), element(DOC_READ_VERSION, b"\2"))
    info = element(INFO, element(TIMESTAMP_SCALE, uint(1_000_000)), element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)), element(MUXER, b"briefspark"), element(WRITER, b"briefspark"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)), element(CHANNELS, b"\1"), element(BIT_DEPTH, b"\x08"))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, b"\1"), element(TRACK_UID, b"\1"), element(TRACK_TYPE, b"\2"), element(LACING, b"\1"), element(CODEC, b"A_PCM/INT/LIT"), element(DEFAULT_DURATION, uint(FRAME * 1_000_000_000 // rate)), audio))
    out, cues = [info, tracks], []
    at = len(info) + len(tracks)
    per_cluster = FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for c in range(0, len(frames), per_cluster):
        start = ms(c * FRAME)
        body = [element(TIMESTAMP, uint(start))]
        for b in range(c, min(c + per_cluster, len(frames)), FRAMES_IN_BLOCK):
            kind, data = lace(frames[b : min(b + FRAMES_IN_BLOCK, c + per_cluster)])
            body.append(element(SIMPLE_BLOCK, vint(1), struct.pack(">h", ms(b * FRAME) - start), bytes([0x80 | kind << 1]), data))
        cues.append(element(CUE_POINT, element(CUE_TIME, uint(start)), element(CUE_POSITIONS, element(CUE_TRACK, b"\1"), element(CUE_CLUSTER, uint(at)))))
        out.append(element(CLUSTER, *body))
        at += len(out[-1])
    return head + element(SEGMENT, *out, element(CUES, *cues))


# --- parsing ---------------------------------------------------------------------------


@dataclass
class Packet:
    track: int
    timestamp_ms: float
    keyframe: bool
    lacing: int
    start: int
    size: int
    cluster: int


@dataclass
class Media:
    doc_type: str = ""
    duration_ms: float = 0.0
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next place); -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError(f"cut short at byte {at}")
    if keep_marker:
        return value, at + width
    value ^= 1 << 7 * width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def children(data: bytes, at: int, end: int, stop_at: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between ``at`` and ``end``; one of unknown size reaches to the next top-level element."""
    while at < end:
        ident, body = read_vint(data, at, keep_marker=True)
        if ident in stop_at:
            return
        size, body = read_vint(data, body)
        if size < 0:
            stop = end
            if ident != SEGMENT:
                stop = body
                for _, _, stop in children(data, body, end, TOP_LEVEL):
                    pass
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} passes the end of its parent")
        yield ident, body, stop
        at = stop


def number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and where the first begins."""
    if kind == NO_LACING:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError(f"{end - at} bytes don't divide by {n} frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length()
            raw = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
            size = raw if i == 0 else sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
            at += width
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes pass the end of the block")
    return sizes, at


def parse(data: bytes) -> Media:
    """Tracks, packets with timestamps and byte ranges, and cues of a Matroska file."""
    out = Media()
    for ident, a, b in children(data, 0, len(data)):
        if ident == EBML:
            out.doc_type = next((data[x:y].decode() for i, x, y in children(data, a, b) if i == DOC_TYPE), "matroska")
        elif ident == SEGMENT:
            _segment(data, a, b, out)
    return out


def _segment(data: bytes, start: int, end: int, out: Media) -> None:
    for ident, a, b in children(data, start, end):
        if ident == INFO:
            found = {i: (x, y) for i, x, y in children(data, a, b)}
            out.scale = number(data, *found[TIMESTAMP_SCALE]) if TIMESTAMP_SCALE in found else 1_000_000
            out.duration_ms = real(data, *found[DURATION]) * out.scale / 1e6 if DURATION in found else 0.0
        elif ident == TRACKS:
            for i, x, y in children(data, a, b):
                if i == TRACK_ENTRY:
                    found = {k: (p, q) for k, p, q in children(data, x, y)}
                    audio = {k: (p, q) for k, p, q in children(data, *found[AUDIO])} if AUDIO in found else {}
                    out.tracks[number(data, *found[TRACK_NUMBER])] = {
                        "codec": data[slice(*found[CODEC])].decode() if CODEC in found else "",
                        "type": number(data, *found[TRACK_TYPE]) if TRACK_TYPE in found else 0,
                        "rate": real(data, *audio[RATE]) if RATE in audio else 8000.0,
                        "bits": number(data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0,
                        "frame_ns": number(data, *found[DEFAULT_DURATION]) if DEFAULT_DURATION in found else 0,
                    }
        elif ident == CLUSTER:
            out.clusters.append(a)
            base = 0
            for i, x, y in children(data, a, b, TOP_LEVEL):
                if i == TIMESTAMP:
                    base = number(data, x, y)
                elif i == SIMPLE_BLOCK:
                    _block(data, x, y, base, out, bool(data[read_vint(data, x)[1] + 2] & 0x80))
                elif i == BLOCK_GROUP:
                    inner = list(children(data, x, y))
                    for k, p, q in inner:
                        if k == BLOCK:
                            _block(data, p, q, base, out, all(j != 0xFB for j, _, _ in inner))
        elif ident == CUES:
            for i, x, y in children(data, a, b):
                if i == CUE_POINT:
                    time = 0
                    for k, p, q in children(data, x, y):
                        if k == CUE_TIME:
                            time = number(data, p, q)
                        elif k == CUE_POSITIONS:
                            found = {j: (r, s) for j, r, s in children(data, p, q)}
                            out.cues.append((time, number(data, *found[CUE_TRACK]), start + number(data, *found[CUE_CLUSTER])))


def _block(data: bytes, a: int, b: int, base: int, out: Media, keyframe: bool) -> None:
    track, at = read_vint(data, a)
    offset = struct.unpack(">h", data[at : at + 2])[0]
    kind = data[at + 2] >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, b, kind)
    step = out.tracks.get(track, {}).get("frame_ns", 0) / 1e6
    for k, size in enumerate(sizes):
        out.packets.append(Packet(track, (base + offset) * out.scale / 1e6 + k * step, keyframe, kind, at, size, len(out.clusters) - 1))
        at += size


# --- operators -------------------------------------------------------------------------

PACKETS = "id bigint, track int, packet bigint, timestamp_ms double, keyframe boolean, lacing int, cluster int, byte_start bigint, byte_length bigint"


def packet_table(media: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row per packet of each Matroska file in ``bytes_col``; null or empty bytes give no rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for ident, data in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if data:
                        rows += [(ident, p.track, k, p.timestamp_ms, p.keyframe, p.lacing, p.cluster, p.start, p.size) for k, p in enumerate(parse(data).packets)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PACKETS.split(", ")])

    return media.select(F.col(id_col).cast("long"), F.col(bytes_col).cast("binary")).mapInArrow(run, PACKETS)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in bytes, and the bytes filled with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % 64 or (0 if data else 64))


def feature(media: Media, payload: bytes) -> str:
    """Counts from the packet table, then mean, root mean square and turns around the middle of the samples."""
    x = np.frombuffer(payload, "u1").astype(np.int64) - 128
    turns = int(np.count_nonzero(np.diff(x >= 0)))
    laced = sum(p.lacing != NO_LACING for p in media.packets)
    last = media.packets[-1].timestamp_ms if media.packets else 0.0
    return (
        f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};laced={laced};"
        f"last_ms={last:.3f};duration_ms={media.duration_ms:.3f};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};turns={turns}"
    )


STORED = "doc_id bigint, n_bytes bigint, media binary"
MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a Matroska file: doc_id, n_bytes (of the text) and media.

    A null text is empty, and stored as 64 zero bytes. Equal texts give equal files. Other columns
    of ``docs`` don't matter.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, payloads = zip(*map(padded, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(map(mux, payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, STORED)


def media_features(stored: DataFrame) -> DataFrame:
    """What parsing the files of ``stored`` (STORED) gives: payload put together from the packets' byte ranges, digests and a feature."""

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import zlib

        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for data in part.column(2).to_pylist():
                    media = parse(data)
                    back = b"".join(data[p.start : p.start + p.size] for p in media.packets)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, back)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=[x.split()[0] for x in MEDIA.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, MEDIA)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text's file to a table in the shared folder, and describe what is read back from there."""
    path = new_folder(spark, "media")
    stored = store_texts(table(spark, sf_dir, "documents"))
    stored.write.option("compression", "zstd").parquet(path)
    return media_features(spark.read.schema(stored.schema).parquet(path))
