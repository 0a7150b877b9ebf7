"""Secret scans with DataFrame functions alone: strong parts by pattern, weak parts by their company.

Strong parts (a secret assigned to a telling name, an access identifier, a long hex run) are
reported wherever they stand. Weak ones, which are common in harmless text, are reported only if
their complement stands in the same scope: a user name beside a secret, a random looking word
beside an identifier, an endpoint beside both. A scope is what blank lines enclose.

No part is its own company. A random word that shares bytes with any other part is that part's
value and counts for nothing; weak parts that share bytes with strong ones, and a user "name"
that is a URL, neither are reported nor count. A user name within a URL is company for secrets,
not for endpoints.

Only lengths leave the scan: each match carries the length of the text before it, and running
sums give places. The interval join is a sweep: parts are ordered by place, and for each the
nearest part of each role before and after it is known from running maxima and minima. A first
sweep finds what overlaps, a second one, over the same order, what is left of each role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm.shared import row_of, table

# Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
USER = r"""(?i)(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
BLOB = r"[A-Za-z0-9+/_-]{24,}={0,2}"
ENDPOINT = r"""(?i)(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+"""
BREAK = r"\n[\x20\t\r]*\n"
KINDS = ["assign", "access", "hex", "user", "blob", "endpoint"]
BASE = 3
USER_KIND, BLOB_KIND, ENDPOINT_KIND, BREAK_KIND, DOC_KIND = 3, 4, 5, 98, 99


def _parts(text: Column, pattern: str, kind: int, ok=lambda m: F.lit(True), if_any: Column | None = None) -> Column:
    """Matches of one kind as (kind, order, length before, length, whether it counts)."""
    shape = "array<struct<kind:int,gap:int,len:int,ok:boolean>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern), found, lambda gap, m: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("len"), ok(m).alias("ok")))
    some = F.size(found) > 0
    return F.when(some if if_any is None else if_any & some, F.slice(both, F.lit(1), F.size(found))).otherwise(F.array().cast(shape)).cast(shape)


def _told(parts: DataFrame, doc: list[str], reach: int | None) -> DataFrame:
    """``parts`` with ``told``: whether each is reported."""
    kind, start, end = F.col("kind"), F.col("start"), F.col("end")
    by_place = [start, kind, end]
    scoped = parts.withColumn("scope", F.sum((kind == BREAK_KIND).cast("int")).over(Window.partitionBy(*doc).orderBy(*by_place)))
    before = Window.partitionBy(*doc, "scope").orderBy(*by_place).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*doc, "scope").orderBy(*(c.desc() for c in by_place)).rowsBetween(Window.unboundedPreceding, -1)

    def nearest(rows: DataFrame, roles: dict[str, Column]) -> DataFrame:
        rows = rows.withColumns({f"{r}_before": F.max(F.when(c, end)).over(before) for r, c in roles.items()})
        return rows.withColumns({f"{r}_after": F.min(F.when(c, start)).over(after) for r, c in roles.items()})

    ahead = lambda r: F.coalesce(F.col(f"{r}_before") > start, F.lit(False))
    behind = lambda r: F.coalesce(F.col(f"{r}_after") < end, F.lit(False))
    met = lambda r: ahead(r) | behind(r)
    scoped = nearest(scoped, {"strong": kind < BASE, "user": kind == USER_KIND, "endpoint": kind == ENDPOINT_KIND})
    void = (kind == USER_KIND) & behind("endpoint") | (kind == BLOB_KIND) & (met("user") | met("endpoint"))
    scoped = scoped.withColumns({"sound": (kind < BASE) | (kind <= ENDPOINT_KIND) & ~met("strong") & ~void, "within": ahead("endpoint")})
    access = F.col("sound") & kind.isin(1, USER_KIND)
    scoped = nearest(scoped, {"access": access, "apart": access & ~(F.col("within") & (kind == USER_KIND)), "secret": F.col("sound") & kind.isin(0, 2, BLOB_KIND)})

    def near(role: str) -> Column:
        close = lambda gap: gap.isNotNull() if reach is None else F.coalesce(gap <= reach, F.lit(False))
        return close(start - F.col(f"{role}_before")) | close(F.col(f"{role}_after") - end)

    company = F.when(kind == USER_KIND, near("secret")).when(kind == BLOB_KIND, near("access")).when(kind == ENDPOINT_KIND, near("apart") & near("secret")).otherwise(kind < BASE)
    return scoped.withColumn("told", F.col("sound") & company)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """One row per distinct (id, text): id, text_key, copies (rows that are like it) and spans.

    ``spans`` is an array of (start, kind, end, name) by start and kind; places count code points,
    the end is exclusive. With ``reach`` complements may be at most so many code points apart,
    else the scope alone decides. A null text is empty and has no spans. ``text_key`` is xxhash64
    of the text, for a join with the documents. Other columns of ``docs`` don't matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    t = F.col("text")
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    weak = [
        _parts(t, USER, USER_KIND, if_any=t.rlike("[:=]")),
        _parts(t, BLOB, BLOB_KIND, mixed),
        _parts(t, ENDPOINT, ENDPOINT_KIND, if_any=t.contains("://")),
    ]
    strong = [
        _parts(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, t.rlike("[:=]")),
        _parts(t, ACCESS, 1, if_any=t.contains("AKIA")),
        _parts(t, HEX, 2),
    ]
    rows = rows.select("id", F.xxhash64("text").alias("text_key"), "text", F.concat(*strong).alias("strong"), F.concat(*weak).alias("weak"))
    breaks = _parts(t, BREAK, BREAK_KIND, if_any=F.size("weak") > 0)
    whole = F.array(F.struct(F.lit(DOC_KIND).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok")))
    parts = rows.select("id", "text_key", F.posexplode(F.concat(whole, F.col("strong"), F.col("weak"), breaks)).alias("order", "p")).select("id", "text_key", "order", "p.*")
    # rows that repeat an id and its text are the same parts once more
    doc = ["id", "text_key"]
    parts = parts.repartition(*doc).groupBy(*doc, "order", "kind", "gap", "len", "ok").agg(F.count("*").alias("copies"))
    upto = Window.partitionBy(*doc, "kind").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len")).filter("ok")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.when(F.col("told"), F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), F.when(F.col("told"), name).alias("name")))
    return _told(parts, doc, reach).groupBy(*doc).agg(F.max(F.when(F.col("kind") == DOC_KIND, F.col("copies"))).alias("copies"), F.sort_array(F.collect_list(span)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    rows = found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return rows.drop("copy")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, mark: str = "[secret]", reach: int | None = None) -> DataFrame:
    """``docs`` with every reported span replaced; rows without spans, and all other columns, stay as they are.

    ``length_col`` is set anew for rows that change. Overlapping spans become one mark. A null
    text stays null. The columns of ``docs`` may have any names.
    """
    found = scan(docs, id_col, text_col, reach).filter(F.size("spans") > 0)
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    cuts = found.select(F.col("id").alias("cut_id"), F.col("text_key").alias("cut_key"), merged.alias("cuts"))
    rows = docs.select(row_of(docs))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    rows = rows.withColumns({"id": F.col("row")[id_col], "key": F.xxhash64(text)})
    rows = rows.join(cuts, (F.col("key") == F.col("cut_key")) & F.col("id").eqNullSafe(F.col("cut_id")), "left")
    c = F.col("cuts")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(c, lambda s: s["end"]))
    ends = F.concat(F.transform(c, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    rows = rows.withColumn("new", F.when(c.isNotNull(), F.array_join(kept, mark)))
    out = {text_col: F.coalesce(F.col("new"), F.col("row")[text_col])}
    if length_col:
        out[length_col] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[length_col].dataType)).otherwise(F.col("row")[length_col])
    return rows.select(*(out.get(n, F.col("row")[n]).alias(n) for n in docs.columns))
