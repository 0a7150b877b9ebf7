"""Quality rules with DataFrame functions alone: counts from the text, then robust multivariate outliers.

For each language and source, each language, and all documents, location and scatter of a vector
of transformed counts are estimated by minimum covariance determinant: of several starts (medians
and quartile ranges; small random subsets) each is concentrated, "take the three quarters of the
documents that are nearest, estimate again from them"; the estimate with the least determinant
is concentrated further. A source's estimate is then drawn towards its language's and that
towards the one of all documents, as if so many documents (WEIGHT) had been seen of those; that
of all is drawn towards a wide prior. So a group of any size has an estimate, and small ones
lean on what is around them. A document is rejected if its Mahalanobis distance by its group's
estimate is too large.

All steps are sums over groups: counts on a grid for quantiles, first and second moments for
estimates. A source with a third of all documents is summed up in every task before anything is
shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm.shared import materialize, row_of, salted_left_join, table

SPACE = "\\x20\\x09-\\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics of the vector, and the deviation that a group is always allowed in each: the unit of all estimates.
VECTOR = {"length": 0.5, "word_length": 0.06, "symbols": 0.015, "capitals": 0.03, "marks": 0.03}
#: Deviations of the prior, in the same order, and of how many documents it and each wider group's estimate count for.
PRIOR, WEIGHT = (3.0, 0.5, 0.2, 0.3, 0.2), 50
D = len(VECTOR)
UNITS = list(VECTOR.values())
#: Shares of short texts are noisy: each text counts as if it went on for so long without capitals and marks.
PRIOR_CHARS, PRIOR_WORDS = 100, 20
#: Share of a group that an estimate is made from; starts, documents of a random one, steps of all and of the best.
SHARE, STARTS, SUBSET, FIRST_STEPS, LAST_STEPS = 0.75, 4, 12, 2, 3
#: Squared distance beyond which a document goes: one in ten million of a normal group.
LIMIT = 42.0
#: Cells of the grids: of a vector's units, and of the logarithm of a squared distance.
GRID, DISTANCE_GRID = 32, 256
#: Groups whose estimates are sent to every task, some 4 MB with all starts; more are joined by key.
SENT_GROUPS = 5_000


def _wilson_hilferty(p_normal: float, d: int) -> float:
    """Quantile of the chi-square distribution, given the normal one's."""
    return d * (1 - 2 / (9 * d) + p_normal * math.sqrt(2 / (9 * d))) ** 3


CHI_MEDIAN = _wilson_hilferty(0.0, D)


# --- counts ----------------------------------------------------------------------------


def _drop(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def add_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns __q_* of its text: counts, and shares for the vector. A null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__q_text", text)
    t = F.col("__q_text")
    out = out.withColumns(
        {
            "__q_hashes": F.transform(F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)),
            "__q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
            "__q_word_chars": F.length(_drop(t, SPACES)).cast("long"),
            "__q_n_symbols": (F.length(t) - F.length(_drop(t, SYMBOLS))).cast("long"),
            "__q_capitals": F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", "")),
            "__q_marks": F.length(t) - F.length(_drop(t, "!?.,;:")),
        }
    )
    h = F.col("__q_hashes")
    starts = F.when(F.size(h) >= 5, F.sequence(F.lit(0), F.size(h) - 5)).otherwise(F.array().cast("array<int>"))
    out = out.withColumns(
        {
            "__q_n_words": F.size(h).cast("long"),
            "__q_n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
            "__q_windows": F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5)))),
        }
    ).drop("__q_hashes", "__q_lines", "__q_text")
    w = F.col("__q_windows")
    repeats = F.size(F.array_distinct(w)) < F.size(w)
    out = out.withColumn("__q_sorted", F.when(repeats, F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("__q_windows")
    s = F.col("__q_sorted")
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    found = F.filter(s, lambda x, i: F.coalesce(same(x, i), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("__q_at", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("__q_sorted")
    # words covered: from each repeated window up to the next one's start, five at most
    covered = F.aggregate("__q_at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    out = out.withColumn("__q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__q_at")
    # a generator stops the optimizer from copying these expressions into filters and each other
    found = [c for c in out.columns if c.startswith("__q_")]
    return out.withColumn("__q", F.explode(F.array(F.struct(*found)))).select(*docs.columns, *(F.col(f"__q.{c}").alias(c) for c in found))


def base_failed() -> Column:
    return (F.col("__q_n_words") < 10) | (100 * F.col("__q_n_repeat_words") > 20 * F.col("__q_n_words"))


def _part(c: str) -> Column:
    """A name with its length before it, so that two of them can be joined; null differs from all names."""
    return F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-"))


def add_vector(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The transformed statistics __q_x0.. in their units, and the keys of the document's group and language."""
    chars, words = F.col("__q_word_chars") + PRIOR_CHARS, F.col("__q_n_words") + PRIOR_WORDS
    values = [F.log1p(F.col("__q_n_words").cast("double")), F.log(chars / words), F.col("__q_n_symbols") / chars, F.col("__q_capitals") / chars, F.col("__q_marks") / chars]
    lang = _part(lang_col)
    keys = {"__q_key": F.concat(lang, F.lit("/"), _part(source_col)), "__q_lang": F.concat(lang, F.lit("/"))}
    return counted.withColumns({f"__q_x{k}": v.cast("double") / UNITS[k] for k, v in enumerate(values)} | keys).drop("__q_capitals", "__q_marks")


# --- estimates -------------------------------------------------------------------------

ALL = "*"
XS = [f"__q_x{k}" for k in range(D)]
MEANS = [f"__q_c{k}" for k in range(D)]
PLACES = [(i, j) for i in range(D) for j in range(i + 1)]
COVARIANCES = [f"__q_v{i}{j}" for i, j in PLACES]
FACTORS = [f"__q_l{i}{j}" for i, j in PLACES]


def with_estimates(rows: DataFrame, estimates: DataFrame, groups: int, on: tuple[str, ...] = ("__q_key",)) -> DataFrame:
    if groups <= SENT_GROUPS:
        return rows.join(F.broadcast(estimates), list(on), "left")
    return salted_left_join(rows, estimates, list(on), [F.col("__q_x0"), F.col("__q_x1")], 64)


def grid_quantiles(rows: DataFrame, by: list[str], cell: str, shares: dict[str, float]) -> DataFrame:
    """For each group the least cell up to which a share of its rows lies; cells are whole numbers of a bounded range."""
    counts = rows.groupBy(*by, cell).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"__upto": F.sum("__n").over(whole.orderBy(cell)), "__all": F.sum("__n").over(whole)})
    return counts.groupBy(*by).agg(*(F.min(F.when(F.col("__upto") >= share * F.col("__all"), F.col(cell))).alias(name) for name, share in shares.items()))


# Expressions over many columns are written as SQL: one call instead of one for every sign.


def squared_distance() -> Column:
    """Of a row's vector from its estimate, by forward substitution in the factor."""
    solved: list[str] = []
    for i in range(D):
        rest = "".join(f" - __q_l{i}{j} * {solved[j]}" for j in range(i))
        solved.append(f"(({XS[i]} - {MEANS[i]}{rest}) / __q_l{i}{i})")
    return F.expr(" + ".join(f"{v} * {v}" for v in solved))


def factored(found: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance in __q_v*, and the logarithm of its determinant."""
    less = lambda i, j: f"__q_v{i}{j}" + "".join(f" - __q_l{i}{k} * __q_l{j}{k}" for k in range(j))
    for j in range(D):
        found = found.selectExpr("*", f"sqrt(greatest({less(j, j)}, 1e-9D)) as __q_l{j}{j}")
        if j < D - 1:
            found = found.selectExpr("*", *(f"({less(i, j)}) / __q_l{j}{j} as __q_l{i}{j}" for i in range(j + 1, D)))
    return found.selectExpr("*", " + ".join(f"2 * ln(__q_l{i}{i})" for i in range(D)) + " as __q_logdet")


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and covariance of each group; the allowed deviation, one unit, is added to each variance."""
    sums = [f"avg({x}) as {c}" for x, c in zip(XS, MEANS, strict=True)] + [f"avg({XS[i]} * {XS[j]}) as __q_v{i}{j}" for i, j in PLACES]
    found = rows.groupBy(*by).agg(*map(F.expr, sums))
    return factored(found.selectExpr(*by, *MEANS, *(f"__q_v{i}{j} - {MEANS[i]} * {MEANS[j]} + {float(i == j)}D as __q_v{i}{j}" for i, j in PLACES)))


def _starts(members: DataFrame, sizes: DataFrame, keys: int) -> DataFrame:
    """(key, start, estimate): 0 from medians and quartile ranges, others from subsets drawn by hash."""
    cells = members.select("__q_key", F.posexplode(F.array(*(F.round(F.col(x) * GRID) for x in XS))).alias("__k", "__cell"))
    quartiles = grid_quantiles(cells, ["__q_key", "__k"], "__cell", {"a": 0.25, "m": 0.5, "b": 0.75})
    of = lambda k, value, name: F.expr(f"max(case when __k = {k} then {value} end) as {name}")
    spread = f"pow(greatest((b - a) / {GRID}D / 1.349D, 1D), 2)"
    centre = quartiles.groupBy("__q_key").agg(*(of(k, f"m / {GRID}D", MEANS[k]) for k in range(D)), *(of(i, spread, f"__q_v{i}{i}") for i in range(D)))
    centre = factored(centre.selectExpr("*", "0 as __q_start", *(f"0D as __q_v{i}{j}" for i, j in PLACES if i != j)))
    drawn = with_estimates(members, sizes.select("__q_key", "__q_n"), keys).withColumn("__q_start", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    chance = F.pmod(F.xxhash64(*XS, "__q_start"), F.lit(1 << 30)) / (1 << 30)
    drawn = moments(drawn.filter(chance < SUBSET / F.col("__q_n")), ["__q_key", "__q_start"])
    return centre.unionByName(drawn)


def _step(members: DataFrame, current: DataFrame, keys: int) -> DataFrame:
    """Each estimate again from the nearest SHARE of its group."""
    by = ["__q_key", "__q_start"]
    placed = with_estimates(members, current.select(*by, *MEANS, *FACTORS), keys)
    placed = placed.select(*by, *XS, F.floor(F.log1p(squared_distance()) * DISTANCE_GRID).alias("__cell"))
    cut = grid_quantiles(placed, by, "__cell", {"__q_cut": SHARE})
    return moments(with_estimates(placed, cut, keys, tuple(by)).filter("__cell <= __q_cut"), by)


def _blend(rows: DataFrame, wider: DataFrame) -> DataFrame:
    """Estimates drawn towards the wider group's (columns with a trailing w), by the number of documents."""
    both = (f"(__q_n * {c} + {WEIGHT} * {c}w) / (__q_n + {WEIGHT}) as {c}" for c in MEANS + COVARIANCES)
    return rows.join(wider, "__q_wider").selectExpr("__q_key", "__q_n", *both)


def _as_wider(found: DataFrame, name: str) -> DataFrame:
    return found.selectExpr(f"__q_key as {name}", *(f"{c} as {c}w" for c in MEANS + COVARIANCES))


def estimates(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Per group key the mean and the factor of the covariance; and how many keys.

    ``vectors`` has __q_key, __q_lang and __q_x*, and is read many times: pass a written table.
    """
    sizes = vectors.groupBy("__q_key", "__q_lang").agg(F.count("*").alias("__q_n"))
    levels = F.array(F.struct(F.col("__q_key").alias("k"), F.col("__q_lang").alias("w")), F.struct(F.col("__q_lang").alias("k"), F.lit(ALL).alias("w")), F.struct(F.lit(ALL).alias("k"), F.lit(None).cast("string").alias("w")))
    sizes = sizes.select(F.explode(levels).alias("l"), "__q_n").groupBy(F.col("l.k").alias("__q_key"), F.col("l.w").alias("__q_wider")).agg(F.sum("__q_n").alias("__q_n"))
    sizes = materialize(sizes, "groups")
    keys = sizes.count()
    members = vectors.select(F.explode(F.array("__q_key", "__q_lang", F.lit(ALL))).alias("__q_key"), *XS)
    current = materialize(_starts(members, sizes, keys), "estimates")
    for _ in range(FIRST_STEPS):
        current = materialize(_step(members, current, keys), "estimates")
    best = F.min_by(F.struct(*MEANS, *COVARIANCES, *FACTORS, "__q_logdet"), F.struct("__q_logdet", "__q_start")).alias("best")
    current = current.groupBy("__q_key").agg(best).select("__q_key", F.lit(0).alias("__q_start"), "best.*")
    for _ in range(LAST_STEPS):
        current = materialize(_step(members, current, keys), "estimates")
    # consistency: half of a normal group lies within the median of the chi-square distribution
    placed = with_estimates(members, current.select("__q_key", *MEANS, *FACTORS), keys)
    middle = grid_quantiles(placed.select("__q_key", F.floor(F.log1p(squared_distance()) * DISTANCE_GRID).alias("__cell")), ["__q_key"], "__cell", {"__h": 0.5})
    factor = f"greatest(expm1((__h + 0.5D) / {DISTANCE_GRID}D) / {CHI_MEDIAN}D, 1D)"
    own = current.select("__q_key", *MEANS, *COVARIANCES).join(middle, "__q_key").selectExpr("__q_key", *MEANS, *(f"{c} * {factor} as {c}" for c in COVARIANCES))
    own = materialize(own.join(sizes, "__q_key"), "estimates")
    prior = [f"{(PRIOR[i] / UNITS[i]) ** 2 if i == j else 0.0}D as __q_v{i}{j}w" for i, j in PLACES]
    top = own.filter(F.col("__q_key") == ALL).withColumn("__q_wider", F.lit(ALL))
    whole = _blend(top, top.selectExpr("__q_wider", *(f"{c} as {c}w" for c in MEANS), *prior))
    langs = _blend(own.filter(F.col("__q_wider") == ALL), _as_wider(whole, "__q_wider"))
    groups = _blend(own.filter(F.col("__q_wider") != ALL), _as_wider(langs, "__q_wider"))
    return materialize(factored(groups).select("__q_key", *MEANS, *FACTORS), "estimates"), keys


def add_verdict(rows: DataFrame, found: DataFrame, keys: int) -> DataFrame:
    """``rows`` (counts and vector) with __q_base_failed, __q_distance (null without an estimate) and __q_kept."""
    rows = with_estimates(rows, found, keys).withColumn("__q_distance", squared_distance())
    return rows.withColumn("__q_base_failed", base_failed()).withColumn("__q_kept", ~F.col("__q_base_failed") & F.coalesce(F.col("__q_distance") <= LIMIT, F.lit(True)))


# --- operators -------------------------------------------------------------------------


def _vectors(rows: DataFrame) -> DataFrame:
    """What estimates are made from: rows that pass the base rules."""
    return rows.filter(~base_failed()).select("__q_key", "__q_lang", *XS)


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns, which may have any names.

    Rows are written once with their counts, so no text is counted twice. A null text has no words
    and fails. Null languages and sources are groups of their own. Repeated rows share their fate.
    An empty table stays empty.
    """
    plain = docs.select(row_of(docs), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = materialize(add_vector(add_counts(plain)).drop("text", "lang", "source"), "counted")
    found, keys = estimates(materialize(_vectors(rows), "vectors"))
    return add_verdict(rows, found, keys).filter("__q_kept").select("row.*")


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, verdict of the base rules and verdict of both for every row."""
    rows = add_vector(add_counts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))))
    rows = materialize(rows.drop("text", "lang", "source"), "counts")
    found, keys = estimates(_vectors(rows))
    return add_verdict(rows, found, keys).select("doc_id", *(F.col(f"__q_{c}").alias(c) for c in COUNTS), F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"), F.col("__q_distance").alias("distance"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"))
