"""URL rules in sorted arrays of 64-bit digests: memory-mapped, probed by binary search, confirmed by the stored strings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.shared import file_system, local_copy, new_folder, table

#: Spark's xxhash64 has the same: builders and readers agree on a key's shard.
SEED = 42
# The rules of the query, as (host, start of the path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Entries of a shard, some 20 MB.
SHARD_ENTRIES = 1 << 18
FILES = ("digests.u64", "ends.u64", "strings.bin", "meta.json")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class DigestIndex:
    """One shard: ascending digests, and at the same places the entries' strings (key, tab, verdict, tab, kind)."""

    def __init__(self, folder: str, cache: dict[str, str]) -> None:
        digests, ends, strings, meta = (local_copy(f"{folder}/{name}", cache) for name in FILES)
        self.meta = json.load(open(meta))
        empty = not self.meta["entries"]
        self.digests = np.zeros(0, "<u8") if empty else np.memmap(digests, "<u8", "r")
        self.ends = np.zeros(0, "<u8") if empty else np.memmap(ends, "<u8", "r")
        self.strings = np.zeros(0, "u1") if empty else np.memmap(strings, "u1", "r")

    def find(self, digests: np.ndarray, keys: list[bytes]) -> list[tuple[int, list[str]]]:
        """(place in ``keys``, fields of the entry) for each key that is stored; equal digests are told apart by the strings."""
        low = np.searchsorted(self.digests, digests, "left")
        high = np.searchsorted(self.digests, digests, "right")
        found = []
        for i in np.flatnonzero(high > low):
            for at in range(int(low[i]), int(high[i])):
                start = int(self.ends[at - 1]) if at else 0
                fields = bytes(self.strings[start : int(self.ends[at])]).decode().rsplit("\t", 2)
                if fields[0].encode() == keys[i]:
                    found.append((int(i), fields))
                    break
        return found


def digest(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), "<u8", len(keys))


def write_shard(folder: str, entries: list[tuple[str, str, str]]) -> None:
    """Entries are (key, verdict, kind); of entries with one key the first in order of (kind, verdict) is kept."""
    best: dict[str, tuple[str, str]] = {}
    for key, verdict, kind in sorted(entries, key=lambda e: (e[2], e[1]), reverse=True):
        best[key] = (verdict, kind)
    keys = [k.encode() for k in best]
    digests = digest(keys)
    order = np.argsort(digests, kind="stable")
    lines = [f"{k}\t{v}\t{kind}".encode() for k, (v, kind) in best.items()]
    lines = [lines[i] for i in order]
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    meta = {"entries": len(lines)}
    for name, data in zip(FILES, (digests[order].tobytes(), np.cumsum([len(x) for x in lines], dtype="<u8").tobytes(), b"".join(lines), json.dumps(meta).encode()), strict=True):
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(data)


def build_index(entries: DataFrame, folder: str, shards: int | None = None) -> int:
    """Write ``entries`` (host, path, verdict, kind) as digest arrays, dealt by digest, each by one task; returns how many.

    Keys are host (A-Z lowered) and path joined; rows with a null or empty host are left out, a
    null path is "/". Each attempt writes a folder of its own; the manifest, written last, names
    those that count. The driver gets one row a shard.
    """
    keyed = entries.filter("host is not null and host <> ''").select(F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit("/"))).alias("key"), F.coalesce("verdict", F.lit("block")).alias("verdict"), F.coalesce("kind", F.lit("list")).alias("kind"))
    keyed = keyed.distinct()
    if shards is None:
        shards = max(1, -(-keyed.count() // SHARD_ENTRIES))
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def write(rows: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        got = [r for batch in rows for r in batch.to_pylist()]
        name = f"shard-{uuid.uuid4().hex}"
        write_shard(f"{folder}/{name}", [(r["key"], r["verdict"], r["kind"]) for r in got])
        lengths = sorted({len(r["key"].partition("/")[2]) + 1 for r in got})
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "name": pa.array([name]), "paths": pa.array([lengths], pa.list_(pa.int64()))})

    written = keyed.repartitionById(shards, F.col("shard")).mapInArrow(write, "shard bigint, name string, paths array<bigint>").collect()
    names = {r["shard"]: r["name"] for r in written}
    manifest = {"shards": [names.get(k) for k in range(shards)], "paths": sorted({n for r in written for n in r["paths"]})}
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return shards


class ShardedIndex:
    """All shards of a folder; one is mapped when a key is first sent to it."""

    def __init__(self, folder: str) -> None:
        self.folder, self.cache, self.open = folder, {}, {}
        with open(local_copy(f"{folder}/manifest.json", self.cache)) as f:
            manifest = json.load(f)
        self.names, self.paths = manifest["shards"], manifest["paths"]

    def find(self, keys: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(place in ``keys``, fields of the entry) for each key that is stored; each key goes to its digest's shard."""
        digests = digest(keys)
        shard = digests.view("<i8") % len(self.names)
        for k in np.unique(shard).tolist():
            if self.names[k] is None:
                continue
            if k not in self.open:
                self.open[k] = DigestIndex(f"{self.folder}/{self.names[k]}", self.cache)
            here = np.flatnonzero(shard == k)
            for at, fields in self.open[k].find(digests[here], [keys[i] for i in here.tolist()]):
                yield int(here[at]), fields


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path as the contract has them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    ends = [i for i in (tail.find(c) for c in "?#") if i >= 0]
    return host, tail[: min(ends, default=len(tail))]


def host_suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [s for s in (".".join(labels[i:]) for i in range(len(labels))) if s]


_INDEXES: dict[str, ShardedIndex] = {}


def load_index(folder: str) -> ShardedIndex:
    """The index of a folder, one per worker."""
    if folder not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[folder] = ShardedIndex(folder)
    return _INDEXES[folder]


def judge(urls: list[str | None], index: ShardedIndex) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) per url: the longest rule that fits, else the longest list entry, else allow."""
    parts = [split_url(u) for u in urls]
    lengths = index.paths
    owners: list[int] = []
    keys: list[bytes] = []
    for i, (host, path) in enumerate(parts):
        for suffix in host_suffixes(host):
            for n in lengths:
                if n <= len(path):
                    owners.append(i)
                    keys.append((suffix + path[:n]).encode())
            if not path and 1 in lengths:  # a bare host is in its list entries, though no rule's path fits
                owners.append(~i)
                keys.append(f"{suffix}/".encode())
    rules: dict[int, tuple[int, str, str]] = {}
    listed: dict[int, tuple[int, str, str]] = {}
    for at, (key, verdict, kind) in index.find(keys):
        owner = owners[at]
        if owner < 0 and kind == "rule":
            continue
        best = rules if kind == "rule" else listed
        owner = ~owner if owner < 0 else owner
        best[owner] = max(best.get(owner, (0, "", "")), (len(key), key, verdict))
    out = []
    for i, (host, path) in enumerate(parts):
        if i in rules:
            out.append((host, path, rules[i][1], rules[i][2]))
        else:
            out.append((host, path, None, listed[i][2] if i in listed else "allow"))
    return out


def filter_urls(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row's url against the index in ``folder``; no shuffle.

    A null url, or one without ``://``, has an empty host and path, no rule, and verdict allow.
    Repeated rows get equal results; ids are passed on as they are, nulls too. Other columns of
    ``pages`` don't matter.
    """

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = load_index(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                host, path, rule, verdict = zip(*judge(part.column(1).to_pylist(), index), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], names=[id_col, "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col))
    return rows.mapInArrow(probe, f"`{id_col}` bigint, host string, path string, rule string, verdict string")


def host_of(url: Column) -> Column:
    """What ``split_url`` gives as the host, as an expression."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


#: The query's list: so many made-up hosts, and an eighth of the hosts of ``pages``, as their MD5 begins.
MADE_UP, LISTED = 1_000_000, "[01]"


def blocked_hosts(pages: DataFrame, made_up: int = MADE_UP) -> DataFrame:
    """(host) of a list of production size, part of which occurs in ``pages``."""
    found = pages.select(host_of(F.col("url")).alias("host")).distinct().filter(F.md5(F.col("host").cast("binary")).rlike(f"^{LISTED}"))
    return pages.sparkSession.range(made_up).select(F.concat(F.lit("ad"), F.col("id").cast("string"), F.lit(".example.org")).alias("host")).union(found)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all of ``pages`` by the rules and, where none fits, by a list of a million blocked hosts."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame([(*r, "rule") for r in RULES], "host string, path string, verdict string, kind string")
    hosts = blocked_hosts(pages).select("host", F.lit("/").alias("path"), F.lit("block").alias("verdict"), F.lit("list").alias("kind"))
    folder = new_folder(spark, "urls")
    build_index(rules.union(hosts), folder)
    return filter_urls(pages, folder)


_FITS = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in RULES)
OP9_SQL = f"""
WITH r AS ({_FITS}),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
b AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n),
l AS (SELECT 'ad' || i::VARCHAR || '.example.org' AS lh FROM range({MADE_UP}) t(i) UNION SELECT host FROM h WHERE host <> '' AND regexp_matches(md5(host), '^{LISTED}')),
p AS (SELECT n, string_split(host, '.') AS labels FROM h),
s AS (SELECT n, unnest(list_transform(generate_series(1, len(labels)), lambda i: array_to_string(labels[i:], '.'))) AS suffix FROM p),
x AS (SELECT DISTINCT n FROM s WHERE suffix IN (SELECT lh FROM l))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rv WHEN n IN (SELECT n FROM x) THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN b USING (n)
"""
