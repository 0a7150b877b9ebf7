"""WARC archives as a Spark data source: write pages as response and revisit records, read them back header first.

Records are gzip members of their own. Each member's gzip header carries the field ``sl``
(skip lengths: compressed and plain size), so the reader steps over an unwanted record after
its WARC headers without inflating the rest. Files lacking that field are inflated and skipped.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from briefspark.llm.shared import file_system, new_folder, salted_left_join, table

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string,"
    " payload_digest string, payload_length bigint, payload binary, headers map<string,string>"
)
# Header fields of the WARC 1.1 format.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIXES = (".warc", ".warc.gz")


# --- bytes -----------------------------------------------------------------------------


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as one gzip member whose extra field ``sl`` tells both sizes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def header_safe(value: str) -> str:
    """Percent-encode what would break a header line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record_bytes(row: dict) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, and so the full length, but no payload."""
    payload, length = row["payload"] or b"", row["payload_length"] or 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1"]
    lines += [f"{name}: {header_safe(row[key])}" for key, name in FIELDS.items() if row.get(key) is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def header_map(head: bytes) -> dict[str, str]:
    """Header lines below the first; a folded line continues the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip()
            out[last] = value.strip()
    return out


class MemberStream:
    """The plain bytes of one gzip member, inflated only as far as they are asked for."""

    def __init__(self, source, step: int = 1 << 14) -> None:
        self.source, self.step, self.start = source, step, source.tell()
        self.plain, self.size = bytearray(), 0
        head = source.read(12)
        if len(head) < 12:
            self.ended = True
            return
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {self.start}")
        extra = source.read(struct.unpack("<H", head[10:12])[0]) if head[3] & 4 else b""
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"sl" and n == 8:
                self.size = struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + n :]
        source.seek(self.start)
        self.inflater, self.read_to, self.ended = zlib.decompressobj(31), self.start, False

    def more(self) -> bool:
        if self.ended:
            return False
        self.source.seek(self.read_to)
        block = self.source.read(self.step)
        if not block:
            raise ValueError(f"the member at byte {self.start} is cut short")
        self.read_to += len(block)
        self.step = min(self.step * 4, 1 << 20)
        self.plain += self.inflater.decompress(block)
        if self.inflater.eof:
            self.read_to -= len(self.inflater.unused_data)
            self.ended = True
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """The end of the first ``mark`` from ``start``."""
        while (at := self.plain.find(mark, start)) < 0:
            start = max(start, len(self.plain) - len(mark))
            if not self.more():
                raise ValueError(f"a record at byte {self.start} has no end of headers")
        return at + len(mark)

    def take(self, start: int, n: int) -> bytes:
        while len(self.plain) < start + n and self.more():
            pass
        return bytes(self.plain[start : start + n])

    def leave(self) -> None:
        """Go to the next member, without inflating this one's rest if its size is known."""
        if self.size and not self.ended:
            self.source.seek(self.start + self.size)
            return
        while not self.ended:
            self.plain.clear()
            self.more()
        self.source.seek(self.read_to)


class PlainStream:
    """The same calls over a record in a file that isn't compressed."""

    def __init__(self, source) -> None:
        self.source, self.start = source, source.tell()
        self.plain, self.end = bytearray(), None

    def more(self) -> bool:
        self.source.seek(self.start + len(self.plain))
        block = self.source.read(1 << 14)
        self.plain += block
        return bool(block)

    until, take = MemberStream.until, MemberStream.take

    def leave(self) -> None:
        self.source.seek(self.end)


def read_records(source, size: int, compressed: bool, wanted, with_payload: bool) -> Iterator[dict]:
    """Parse a file's records: headers first, the rest only of records that ``wanted(row)`` accepts."""
    at = source.tell()
    while at < size:
        stream = MemberStream(source) if compressed else PlainStream(source)
        head_end = stream.until(b"\r\n\r\n")
        headers = header_map(bytes(stream.plain[: head_end - 4]))
        block_length = int(headers.get("Content-Length", 0))
        if not compressed:
            stream.end = stream.start + head_end + block_length + 4
        row = {key: headers.get(name) for key, name in FIELDS.items()} | {"headers": headers, "payload": None, "payload_length": block_length}
        if wanted(row):
            body = head_end
            if headers.get("Content-Type", "").startswith("application/http") and block_length:
                body = stream.until(b"\r\n\r\n", head_end)
                http = header_map(bytes(stream.plain[head_end : body - 4]))
                row["payload_length"] = int(http.get("Content-Length", head_end + block_length - body))
            if with_payload and row["record_type"] != "revisit":
                row["payload"] = stream.take(body, head_end + block_length - body)
            yield row
        stream.leave()
        at = source.tell()


# --- data source -----------------------------------------------------------------------


@dataclass
class FilesPartition(InputPartition):
    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(files)
        self.files = files


@dataclass
class WrittenFiles(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    """Pushes down equality, IN and prefix tests on the columns that come from headers."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in FIELDS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if system.get_file_info(path).type != fs.FileType.File else [system.get_file_info(path)]
        groups: list[list[tuple[str, int]]] = []
        room = 0
        for info in sorted((i for i in found if i.path.endswith(SUFFIXES) and i.size), key=lambda i: i.path):
            if info.size > room or not groups:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append((info.path, info.size))
            room -= info.size
        return [FilesPartition(g) for g in groups] or [FilesPartition([])]

    def wanted(self, row: dict) -> bool:
        return all(row[name] is not None and (row[name] in value if kind == "in" else row[name].startswith(value)) for name, kind, value in self.tests)

    def read(self, partition):
        system, _ = file_system(self.path)
        for path, size in partition.files:
            with system.open_input_file(path) as source:
                for row in read_records(source, size, path.endswith(".gz"), self.wanted, self.with_payload):
                    yield (row["record_type"], row["record_id"], row["target_uri"], row["warc_date"], row["refers_to"], row["payload_digest"], row["payload_length"], row["payload"], row["headers"])


class WarcWriter(DataSourceArrowWriter):
    """Every task attempt writes files of its own name; the commit moves those of the attempts that count."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.file_bytes = int(options.get("filebytes", 256 << 20))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, path = file_system(self.path)
        staging = f"{path}/_staging-{self.job}"
        system.create_dir(staging, recursive=True)
        files: list[str] = []
        out, room = None, 0
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 256):
                    for row in batch.slice(at, 256).to_pylist():
                        data = member(record_bytes(row))
                        if out is None or len(data) > room:
                            if out:
                                out.close()
                            files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                            out, room = system.open_output_stream(f"{staging}/{files[-1]}", compression=None), self.file_bytes
                        out.write(data)
                        room -= len(data)
        finally:
            if out:
                out.close()
        return WrittenFiles(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, path = file_system(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if info.path.endswith(SUFFIXES):
                    system.delete_file(info.path)
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{path}/_staging-{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, path = file_system(self.path)
        if system.get_file_info(f"{path}/_staging-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/_staging-{self.job}")


class WarcDataSource(DataSource):
    """``format("warc")``. Options: path; payload=false leaves payloads unread; partitionBytes; fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- operator --------------------------------------------------------------------------


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows of the WARC schema for ``pages``; null html is an empty payload.

    Of equal payloads of at least ``least`` bytes, the row with the smallest id is the response
    and the others revisit it. Rows that repeat the smallest id are all responses. A row with a
    null id never is what others refer to; if all ids of a payload are null, all are responses.
    Record ids are ``<urn:page:ID>``, or ``<urn:page:none>`` for a null id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first_id")
    joined = salted_left_join(rows, firsts, ["digest"], [F.col("id"), F.col("url")])
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("id")).alias("record_id"),
        F.coalesce("url", F.lit("about:blank")).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.lit(None).cast("map<string,string>").alias("headers"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``; filters on header columns reach the reader."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of ``pages`` and read the archives back: responses with their payloads, digested again, and revisits from their headers alone."""
    path = new_folder(spark, "warc")
    write_archives(archive_records(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")

    def described(kind: str, size: Column, digest: Column) -> DataFrame:
        found = read_archives(spark, path, payload=kind == "response").filter(F.col("record_type") == kind)
        return found.select(page("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))

    responses = described("response", F.octet_length("payload"), F.sha2("payload", 256))
    return responses.unionByName(described("revisit", F.col("payload_length"), F.regexp_replace("payload_digest", "^sha256:", "")))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
