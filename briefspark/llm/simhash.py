"""SimHash near-duplicates: BK-trees over shards of distinct fingerprints.

A BK-tree keeps children by their integer Hamming distance to the parent; a search follows only
edges whose distance is within the radius of the query's own. One tree over everything would
have to be sent to all tasks. Instead fingerprints are dealt into shards by blocks of bits: of
radius + 1 blocks, two fingerprints within the radius agree in one at least. Each shard's tree is
built and searched where the shard is, and all trees of a task are walked together, level by
level. A shard with too many members is dealt again by blocks of its other bits, by the same
argument, so every link is found and no task gets a shard larger than its bits allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm.components import components
from briefspark.llm.shared import materialize, row_of, salted_left_join, table

SEED = 42
SHARD_LIMIT = 20_000
#: Shards are walked together up to so many members, and so many (query, node) pairs at a time.
FOREST, FRONTIER = 100_000, 2_000_000


# --- fingerprints ----------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, "<u8")
    h = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return np.array([h(b" ".join(tokens), SEED)], "<u8")
    return np.array([h(s, SEED) for s in map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed) of every row; null or wordless texts have fingerprint 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [fingerprint(shingle_hashes(t, words)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


# --- trees -----------------------------------------------------------------------------


class BkForest:
    """BK-trees of many shards. Members are distinct within a shard and ordered by shard."""

    def __init__(self, values: np.ndarray, shard: np.ndarray) -> None:
        self.values = values
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = np.repeat(first, np.diff(np.r_[first, len(shard)]))
        pending = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        at = self.root[pending]
        edges, nodes = [], []
        while len(pending):
            key = at * 65 + np.bitwise_count(values[pending] ^ values[at])
            edge, where, group = np.unique(key, return_index=True, return_inverse=True)
            child = pending[where]
            edges.append(edge)
            nodes.append(child)
            at = child[group]
            stays = at != pending
            pending, at = pending[stays], at[stays]
        edge, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, nodes))
        order = np.argsort(edge)
        self.edge, self.node = edge[order], node[order]
        self.before = None

    def index(self) -> BkForest:
        """For searches that follow most edges: the number of edges before each, 260 bytes a member, instead of binary searches."""
        self.before = np.r_[0, np.cumsum(np.bincount(self.edge, minlength=65 * len(self.values)))].astype(np.int32)
        return self

    def pairs(self, queries: np.ndarray, radius: int, both: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, other member of its shard within the radius), the other before the query; with ``both`` also after and itself."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = [(queries, self.root[queries])]
        while waiting:
            q, node = waiting.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                waiting += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            far = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
            near = far <= radius if both else (far <= radius) & (node < q)
            found.append((q[near], node[near]))
            least, most = node * 65 + np.maximum(far - radius, 0), node * 65 + np.minimum(far + radius, 64)
            if self.before is None:
                low, high = np.searchsorted(self.edge, least, "left"), np.searchsorted(self.edge, most, "right")
            else:
                low, high = self.before[least], self.before[most + 1]
            many = high - low
            if total := int(many.sum()):
                offset = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                waiting.append((np.repeat(q, many), self.node[np.repeat(low, many) + offset]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (queries[:0], queries[:0])


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of each pair; a label is the least member of its class."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def linked(values: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least-placed member of its class) for classes of more than one within a shard."""
    forest, label = BkForest(values, shard), np.arange(len(values))
    for at in range(0, len(values), 4096):
        union(label, *forest.pairs(np.arange(at, min(at + 4096, len(values))), radius))
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


# --- links -----------------------------------------------------------------------------


def block_of(fp: Column, bits: list[int]) -> Column:
    """The value of these bits, from the first as the highest; runs of adjacent bits take one shift."""
    out, k = F.lit(0).cast("long"), 0
    while k < len(bits):
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] + n:
            n += 1
        out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned(fp, bits[k]).bitwiseAND(F.lit((1 << n) - 1)))
        k += n
    return out


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[k * len(bits) // parts : (k + 1) * len(bits) // parts] for k in range(parts)]


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links u > v from rows (shard, fp): a star for each class that a shard's tree has found."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(keys: np.ndarray, fps: np.ndarray):
            a, b = linked(fps.view("<u8"), keys, radius)
            a, b = a.view("<i8"), b.view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False)]
            if len(keys) >= FOREST:
                end = int(np.searchsorted(keys, keys[-1], "left"))  # whole shards
                if end:
                    yield links(keys[:end], fps[:end])
                    keys, fps = keys[end:], fps[end:]
        if len(keys):
            yield links(keys, fps)

    return shards.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "u bigint, v bigint")


def fingerprint_links(distinct: DataFrame, radius: int = 2, limit: int = SHARD_LIMIT) -> DataFrame:
    """All pairs of fingerprints within the radius, as far as components need them: u > v.

    ``distinct`` has each fp once. Shards over ``limit`` are dealt again by their free bits; with
    few free bits left a shard can't hold more than those bits tell apart.
    """
    out, level = None, [(distinct.select("fp", F.lit(0).cast("long").alias("shard")), list(range(64)))]
    while level:
        following = []
        for rows, bits in level:
            for k, block in enumerate(split_bits(bits, radius + 1)):
                free = [b for b in bits if b not in set(block)]
                dealt = rows.select("fp", F.xxhash64("shard", F.lit(64 * len(bits) + k), block_of(F.col("fp"), block)).alias("shard"))
                sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
                sizes = materialize(sizes, "shards")
                hot = sizes.filter(F.col("n") > limit).select("shard")
                deeper = 1 << len(free) > limit and not hot.isEmpty()
                near = sizes if not deeper else sizes.filter(F.col("n") <= limit)
                found = shard_links(dealt.join(near.select("shard"), "shard").select("shard", "fp"), radius)
                out = found if out is None else out.union(found)
                if deeper:
                    following.append((materialize(dealt.join(hot, "shard").select("fp", "shard"), "shards"), free))
        level = following
    return out


# --- operators -------------------------------------------------------------------------


def rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, copies, ..) with root, the least fingerprint of the component; without those that stand alone."""
    stars = components(fingerprint_links(distinct.select("fp"), radius))
    members = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(stars.select(F.col("v"), F.col("v")).distinct())
    return distinct.join(members, "fp", "left").filter("root is not null or copies > 1").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    A component's id is the smallest doc_id of all rows whose fingerprints are reachable by links
    of at most ``radius`` bits. Null, empty and wordless texts have fingerprint zero and are
    linked like any other. Repeated rows stay; a null doc_id is never the smallest unless a
    component has no other.
    """
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "distinct")
    linked_rows = rooted(distinct, radius).select("fp", "root", "first_id")
    least = linked_rows.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(salted_left_join(linked_rows, least, ["root"], [F.col("fp")]).select("fp", "component_id"), "named")
    return salted_left_join(rows, named, ["fp"], [F.col("doc_id")]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


# --- similarity of a given degree ------------------------------------------------------
#
# The same fingerprints and trees, of sets of shingles, so that a repeated phrase moves none. Those
# of texts that overlap by 0.8 differ in some ten of 64 bits, too many to deal by blocks of bits.
# Two kinds of shards take the place of blocks: components of fingerprints within OWN_RADIUS bits,
# by the links above, and bands of min-hashes, for pairs farther apart. In each shard the BK-tree
# of its fingerprints is searched with a wide radius, and only pairs that it finds are judged.
#
# A first judgement is by min-hashes, of which two bits are kept: unequal ones agree in a quarter
# of all cases, which is allowed for, and 512 of them take no more room than 128 whole bytes but
# tell similarities apart better. They settle pairs that are SIGMAS standard deviations from the
# asked similarity; pairs between, unless joined already, are judged by their sets of shingles.
# Texts that share no shard with another leave before signatures are dealt.

BANDS, ROWS, HASHES = 16, 4, 512
SIGMAS = 4.5
#: Bits within which fingerprints are linked whatever their bands, and standard deviations that a shard's search goes beyond the mean of pairs just similar enough.
OWN_RADIUS, WIDE_SIGMAS = 2, 5.5
#: Words of a signature by which most pairs are told unlike.
FEW = 4
_LOW_BITS = np.uint64(0x5555555555555555)
#: In shards up to this size every member searches the tree; in larger ones most members are joined by pivots first.
TREE_LIMIT = 512
#: Pairs that searches of a large shard may list at a time.
LISTED = 1 << 19
#: Members, and bytes of sets, that one task takes; larger shards are cut, and each two cuts are dealt together.
CUT, CUT_BYTES = 50_000, 64 << 20
#: Texts asked for by name that are sent to every task, some 10 MB; more are joined by key.
SENT_NODES = 100_000


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 32, (2, HASHES), dtype=np.uint64).astype(np.uint32)[:, :, None] | np.array([[[1]], [[0]]], np.uint32)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; one stands for no words."""
    hashes = np.unique(shingle_hashes(text, words))
    return hashes if len(hashes) else np.zeros(1, "<u8")


def signature(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """Two bits of each min-hash of a set of shingles, and the keys of its bands."""
    import xxhash

    factor, offset = _multipliers()
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), 512):
        y = x[None, at : at + 512] * factor + offset
        y ^= y >> np.uint32(15)
        least = np.minimum(least, y.min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]
    fields = (least * np.uint32(2654435761) >> np.uint32(30)).astype(np.uint8).reshape(-1, 4)
    return (fields << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes(), keys


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-hashes that differ between rows of signatures, as far as two bits tell."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & _LOW_BITS).sum(axis=-1)


def unequal_limits(similarity: float) -> tuple[int, int]:
    """Up to how many unequal min-hashes a pair surely is alike, and beyond how many it surely isn't."""
    share = (1 - similarity) * 0.75
    spread = SIGMAS * np.sqrt(HASHES * share * (1 - share))
    return int(HASHES * share - spread), int(np.ceil(HASHES * share + spread))


def wide_radius(similarity: float) -> int:
    """Bits within which the fingerprints of similar sets lie, but for some two in ten million at 0.8.

    Of two sets a bit differs as often as random halves of space part their vectors: by the angle
    between them, widest for sets of equal size.
    """
    share = np.arccos(min(2 * similarity / (1 + similarity), 1.0)) / np.pi
    return min(int(np.ceil(64 * share + WIDE_SIGMAS * np.sqrt(64 * share * (1 - share)))), 64)


def _text_node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (MD5 of the text), fp (of the set of shingles), sig and bands of every row; a null text is empty."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        known: dict[bytes, tuple] = {}  # copies of a text tend to be many
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    node = hashlib.md5((text or "").encode()).digest()
                    if node not in known:
                        if len(known) >= 20_000:
                            known.clear()
                        hashes = shingle_set(text, words)
                        known[node] = (node, fingerprint(hashes), *signature(hashes))
                    rows.append(known[node])
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "node", "fp", "sig", "bands"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, node binary, fp bigint, sig binary, bands array<bigint>")


def _middle(sigs: np.ndarray) -> int:
    """The member that agrees most with what most members have at each bit."""
    ones = sum(np.unpackbits(part.view("u1"), axis=1).sum(axis=0, dtype=np.int64) for part in np.array_split(sigs, -(-len(sigs) // 4096)))
    return int(np.bitwise_count(sigs ^ np.packbits(2 * ones > len(sigs)).view("<u8")).sum(axis=1).argmin())


class MemberTrees:
    """BK-trees of shards whose members may share fingerprints: a node stands for all that do. Members are ordered by shard."""

    def __init__(self, values: np.ndarray, shard: np.ndarray, radius: int) -> None:
        self.radius, self.order = radius, np.lexsort((values, shard))
        v, s = values[self.order], shard[self.order]
        new = np.r_[True, (v[1:] != v[:-1]) | (s[1:] != s[:-1])][: len(v)]
        self.start = np.flatnonzero(new)
        self.many = np.diff(np.r_[self.start, len(v)])
        self.node = np.empty(len(v), np.int64)
        self.node[self.order] = np.cumsum(new) - 1
        self.forest = BkForest(v[self.start], s[self.start]).index()

    def near(self, q: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
        """(member of ``q``, member of its shard within the radius); unless ``both``, once for two members of ``q``, but those of a node."""
        q = q[np.argsort(self.node[q], kind="stable")]
        nodes, first, own = np.unique(self.node[q], return_index=True, return_counts=True)
        a, b = self.forest.pairs(nodes, self.radius, both)
        if not both:
            a, b = np.r_[a, nodes], np.r_[b, nodes]
        at, width = np.searchsorted(nodes, a), self.many[b]
        total = own[at] * width
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(width, total)
        return q[np.repeat(first[at], total) + k // width], self.order[np.repeat(self.start[b], total) + k % width]


def _meet(x: np.ndarray, y: np.ndarray, sigs: np.ndarray, few: np.ndarray, label: np.ndarray, doubt: np.ndarray, sure: int, maybe: int) -> None:
    """Join the surely similar of these pairs, and mark those that may be similar, unless joined already."""
    apart = label[x] != label[y]
    x, y = x[apart], y[apart]
    for at in range(0, len(x), 1 << 16):
        a, b = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        left = unequal(few[a], few[b]) <= maybe
        a, b = a[left], b[left]
        far = unequal(sigs[a], sigs[b])
        union(label, a[far <= sure], b[far <= sure])
        between = (far > sure) & (far <= maybe)
        a, b = a[between], b[between]
        apart = label[a] != label[b]
        doubt[a[apart]] = doubt[b[apart]] = True


def _large_classes(sigs: np.ndarray, values: np.ndarray, label: np.ndarray, doubt: np.ndarray, sure: int, maybe: int, radius: int) -> None:
    """Join a large shard's members: pivots in the middle take most of them; then all outside the largest class search the tree."""
    trees = MemberTrees(values, np.zeros(len(values), np.int64), radius)
    everyone = np.arange(len(sigs))
    pool = everyone
    while len(pool) > TREE_LIMIT:
        pivot = int(pool[_middle(sigs[pool])])
        near = trees.near(np.array([pivot]), both=True)[1]
        near = near[unequal(sigs[near], sigs[pivot]) <= sure]
        union(label, near, np.full(len(near), pivot))
        rest = pool[label[pool] != label[pivot]]
        if len(rest) > 0.95 * len(pool):
            break
        pool = rest
    classes, sizes = np.unique(label, return_counts=True)
    few = np.ascontiguousarray(sigs[:, :FEW])
    outside = everyone[label != classes[sizes.argmax()]]
    step = max(LISTED // len(sigs), 1)
    for at in range(0, len(outside), step):
        _meet(*trees.near(outside[at : at + step], both=True), sigs, few, label, doubt, sure, maybe)


def _first_of_equals(sigs: np.ndarray, values: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each member the first of its shard with the same fingerprint and signature."""
    mixed = (sigs * np.arange(1, 2 * sigs.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((mixed, values, shard))
    a, b = order[1:], order[:-1]
    new = (shard[a] != shard[b]) | (values[a] != values[b]) | (mixed[a] != mixed[b])
    same = np.flatnonzero(~new)
    new[same] = (sigs[a[same]] != sigs[b[same]]).any(axis=1)
    new = np.r_[True, new][: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # lexsort is stable
    return out


def similar_classes(sigs: np.ndarray, shard: np.ndarray, sure: int, maybe: int, values: np.ndarray | None = None, radius: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Labels that join surely similar members of each shard, and which members may be similar to one of another class.

    Only members whose fingerprints (``values``) lie within the radius are compared; without
    fingerprints all are. Members are ordered by shard.
    """
    values = np.zeros(len(sigs), "<u8") if values is None else values
    equal = _first_of_equals(sigs, values, shard)
    one = np.flatnonzero(equal == np.arange(len(sigs)))
    label, doubt = _classes_of_distinct(np.ascontiguousarray(sigs[one]), shard[one], sure, maybe, values[one], radius)
    at = np.searchsorted(one, equal)
    return one[label][at], doubt[at]


def _classes_of_distinct(sigs: np.ndarray, shard: np.ndarray, sure: int, maybe: int, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    label, doubt = np.arange(len(sigs)), np.zeros(len(sigs), bool)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    size = np.diff(np.r_[first, len(shard)])
    for a, n in zip(first[size > TREE_LIMIT], size[size > TREE_LIMIT], strict=True):
        own = np.arange(n)
        _large_classes(sigs[a : a + n], values[a : a + n], own, doubt[a : a + n], sure, maybe, radius)
        label[a : a + n] = own + a
    few = np.ascontiguousarray(sigs[:, :FEW])
    small = np.flatnonzero(np.repeat((size > 1) & (size <= TREE_LIMIT), size))
    trees = MemberTrees(values[small], shard[small], radius)
    for at in range(0, len(small), 2048):
        x, y = trees.near(np.arange(at, min(at + 2048, len(small))), both=False)
        _meet(small[x], small[y], sigs, few, label, doubt, sure, maybe)
    alone = np.minimum.reduceat(label, first) == np.maximum.reduceat(label, first) if len(first) else first
    doubt[np.repeat(alone, size)] = False
    return label, doubt


def _by_shard(run, shards: DataFrame, schema: str, limit: int) -> DataFrame:
    """Give whole shards to ``run``, (shard, node, column..) lists of some ``limit`` rows or bytes at a time, ordered by shard and node."""

    def go(batches: Iterator) -> Iterator:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            held += batch.num_rows if limit == CUT else batch.nbytes
            if held >= limit and rows[0][0] != rows[-1][0]:
                end = next(i for i in range(len(rows) - 1, -1, -1) if rows[i][0] != rows[-1][0]) + 1
                yield from run(rows[:end])
                held, rows = held * (len(rows) - end) // len(rows), rows[end:]
        if rows:
            yield from run(rows)

    return shards.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(go, schema)


def _cut_crowds(rows: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """``rows`` (shard, node, ..) with shards heavier than ``limit`` cut by hash into parts of half of it, each two parts a shard.

    ``weights`` (shard, weight) has every shard that is kept. Any two members of a shard meet in
    one at least. For a weight w that takes about 2 w / limit copies of each.
    """
    rest = [c for c in rows.columns if c != "shard"]
    dealt = salted_left_join(rows, weights, ["shard"], [F.col("node")]).filter("weight is not null")
    dealt = dealt.withColumn("parts", F.when(F.col("weight") > limit, F.ceil(2 * F.col("weight") / limit)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: k != F.col("part"))
    pairs = F.transform(others, lambda k: F.xxhash64("shard", F.least(k, "part"), F.greatest(k, "part")))
    return dealt.select(F.explode(F.when(F.col("parts").isNull(), F.array("shard")).otherwise(pairs)).alias("shard"), *rest)


FOUND = "shard bigint, u binary, v binary"


def _found_rows(rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [(), (), ()], (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "u", "v"])


def _star(nodes: list[bytes], label: np.ndarray) -> list[tuple]:
    moved = np.flatnonzero(label != np.arange(len(label)))
    pairs = [(nodes[i], nodes[j]) for i, j in zip(moved.tolist(), label[moved].tolist(), strict=True)]
    return [(None, max(p), min(p)) for p in pairs]


def fingerprint_shards(distinct: DataFrame, radius: int = OWN_RADIUS) -> DataFrame:
    """(node, shard) of the texts (node, fp) whose fingerprints are equal to or linked with another's: a shard for each component."""
    values = materialize(distinct.groupBy("fp").agg(F.count("*").alias("copies")), "values")
    roots = rooted(values, radius).select("fp", "root")
    named = salted_left_join(distinct.select("node", "fp"), roots, ["fp"], [F.col("node")]).filter("root is not null")
    return materialize(named.select("node", F.xxhash64(F.lit("fingerprints"), "root").alias("shard")), "places")


def band_links(distinct: DataFrame, similarity: float) -> DataFrame:
    """What the signatures (node, fp, sig, bands) tell: links u > v without a shard, and members u of a shard in doubt.

    For the latter v is the node that stands for u's class there. Shards are bands and components
    of fingerprints; those of one text are left out before any signature is shuffled. Without fp
    all texts of a shard are compared.
    """
    sure, maybe = unequal_limits(similarity)
    radius = wide_radius(similarity)

    def run(rows: list[tuple]) -> Iterator:
        keys, nodes, fps, sigs = zip(*rows, strict=True)
        keys, sigs = np.array(keys, np.int64), np.frombuffer(b"".join(sigs), "<u8").reshape(-1, HASHES // 32)
        label, doubt = similar_classes(sigs, keys, sure, maybe, np.array(fps, np.int64).view("<u8"), radius)
        found = _star(nodes, label) + [(int(keys[i]), nodes[i], nodes[label[i]]) for i in np.flatnonzero(doubt).tolist()]
        for at in range(0, len(found), 10_000):
            yield _found_rows(found[at : at + 10_000])

    places = distinct.select("node", F.explode("bands").alias("shard"))
    if "fp" in distinct.columns:
        places = places.union(fingerprint_shards(distinct))
    else:
        distinct = distinct.withColumn("fp", F.lit(0).cast("long"))
    shared = materialize(places.groupBy("shard").agg(F.count("*").alias("weight")).filter("weight > 1"), "shared")
    dealt = _cut_crowds(places, shared, CUT)
    dealt = dealt.join(distinct.select("node", "fp", "sig"), "node").select("shard", "node", "fp", "sig")
    return _by_shard(run, dealt, FOUND, CUT)


def exact_links(doubtful: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between members (shard, node, root) of a shard whose roots differ, judged by their sets of shingles.

    ``texts`` has node, sig, shingles and bytes (of shingles). Crowds are cut before sets are shuffled.
    """
    sure, maybe = unequal_limits(similarity)

    def judge(nodes: list[bytes], roots: list[bytes], sigs: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        least = {}
        label = np.array([least.setdefault(r, i) for i, r in enumerate(roots)])
        sizes = np.array([len(x) for x in sets])
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        few, own = np.ascontiguousarray(sigs[:, :FEW]), np.zeros(len(values), bool)
        for q in range(1, len(nodes)):
            near = np.flatnonzero((label[:q] != label[q]) & (np.minimum(sizes[:q], sizes[q]) >= similarity * np.maximum(sizes[:q], sizes[q]) - 1e-9))
            near = near[unequal(few[near], few[q]) <= maybe]
            far = unequal(sigs[near], sigs[q])
            near = near[(far > sure) & (far <= maybe)]
            if not len(near):
                continue
            mine = ids[ends[q] - sizes[q] : ends[q]]
            own[mine] = True
            for p in near.tolist():
                if label[p] != label[q]:
                    both = int(own[ids[ends[p] - sizes[p] : ends[p]]].sum())
                    if both >= similarity * (sizes[p] + sizes[q] - both) - 1e-9:
                        union(label, np.array([p]), np.array([q]))
            own[mine] = False
        return label

    def run(rows: list[tuple]) -> Iterator:
        at, found = 0, []
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            _, nodes, roots, sigs, sets = zip(*rows[at:end], strict=True)
            label = judge(nodes, roots, np.frombuffer(b"".join(sigs), "<u8").reshape(-1, HASHES // 32), [np.frombuffer(x, "<u8") for x in sets])
            found += _star(nodes, label)
            at = end
        for k in range(0, len(found), 10_000):
            yield _found_rows(found[k : k + 10_000])

    weights = doubtful.select("shard", "node").join(texts.select("node", "bytes"), "node").groupBy("shard").agg(F.sum("bytes").alias("weight"))
    dealt = _cut_crowds(doubtful, materialize(weights, "weights"), CUT_BYTES).join(texts.drop("bytes"), "node").select("shard", "node", "root", "sig", "shingles")
    return _by_shard(run, dealt, FOUND, CUT_BYTES).select("u", "v")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the texts that ``nodes`` (node, doc_id) names; no others' text is looked at."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", _text_node(F.col("text")))
    few = nodes.count() <= SENT_NODES
    asked = F.broadcast(nodes) if few else nodes.hint("merge")
    rows = texts.join(asked, (F.col("key") == F.col("node")) & F.col("id").eqNullSafe(F.col("doc_id"))).select("node", "text")
    return rows.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of exact and near copies the row with the smallest id, with all its columns.

    Texts are alike if their sets of shingles overlap by ``similarity`` or more; groups are
    components of such pairs. Pairs whose fingerprints differ in more than two bits and that share
    no band of min-hashes aren't found (at 0.8 two in ten thousand). Case of A-Z and white space don't count. Null and wordless texts are one
    group. Of repeated rows one stays; a null id stays only if its group has no other. The columns
    of ``docs`` may have any names.
    """
    rows = signatures(docs, words, id_col, text_col)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    distinct = materialize(rows.groupBy("node").agg(smallest, F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "distinct")
    found = materialize(band_links(distinct.select("node", "fp", "sig", "bands"), similarity), "found")
    links = found.filter("shard is null").select("u", "v")
    doubt = found.filter("shard is not null").select("shard", F.col("u").alias("node"), F.col("v").alias("root"))
    if not doubt.isEmpty():
        nodes = materialize(doubt.select("node").distinct().join(distinct.select("node", F.col("first.doc_id").alias("doc_id"), "sig"), "node"), "doubtful")
        sets = shingle_sets(docs, nodes.select("node", "doc_id"), words, id_col, text_col)
        texts = materialize(nodes.select("node", "sig").join(sets, "node").withColumn("bytes", F.octet_length("shingles").cast("long")), "texts")
        links = links.union(exact_links(doubt, texts, similarity))
    stars = components(links)
    named = distinct.select("node", "first").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    best = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("first", "node")).alias("best"))
    keep = best.select(F.col("best.first.doc_id").alias("keep_id"), F.col("best.node").alias("keep_node"))
    kept = docs.select(row_of(docs)).withColumns({"id": F.col("row")[id_col].cast("long"), "node": _text_node(F.col("row")[text_col])})
    kept = kept.join(keep, (F.col("node") == F.col("keep_node")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    first = Window.partitionBy("id", "node").orderBy(F.lit(0))
    return kept.withColumn("k", F.row_number().over(first)).filter("k = 1").select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
