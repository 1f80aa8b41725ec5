"""Quality rules: plain limits, then a robust multivariate outlier test per language and source.

Everything is DataFrame expressions. The text statistics are computed row by row from the
whole text. The minimum-covariance-determinant estimate of a group (language, source) is
found by concentration steps: the 75 % of the group's rows nearest to the present centre give
the next centre and covariance. A step is one aggregation of fixed-size sums, combined before
the shuffle, so a group with a third of all rows costs no more than any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised, materialised_small, sized, with_row

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"
SPAN = 8
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
# Estimates of up to so many groups are sent to all tasks; of more, they meet their rows in a join.
FEW_GROUPS = 10_000
# Share of a group that the estimate rests on, steps, and rows below which the estimate over
# all rows stands in for the group's own.
KEPT_SHARE, STEPS, MIN_GROUP = 0.75, 3, 50
FEATURES = ["f_length", "f_symbols", "f_lines", "f_repeats"]
# Chance that a row of a normal group lies beyond the limit.
TAIL = 1e-9
# Per cent that a text may have of symbols, repeated lines and repeated words, and times by
# which its mean word may be longer, however alike the other texts of its group are. Most
# clean rows have no symbol and no repetition at all; with a spread of zero, one would be an outlier.
TOLERATED = {"f_length": 2.0, "f_symbols": 5, "f_lines": 30, "f_repeats": 30}


def hashed_with(width: int):
    """A hash with the one ``width`` places further on."""
    return lambda h, i: F.xxhash64(h, F.get("_hashes", i + width))


def statistics(docs: DataFrame) -> DataFrame:
    """Adds the five counts and the transformed vector to rows with a ``text`` column.

    A null or empty text has no words and zeros everywhere. Windows of eight words are
    compared by a 64-bit hash within one text; a word counts once however many repeated
    windows cover it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    split = docs.select(
        "*", F.when(trimmed != "", F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"))
    words = F.col("_words")
    counted = split.select(
        *docs.columns, "n_symbols", F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= SPAN, F.transform(words, lambda w: F.xxhash64(w))).alias("_hashes"))
    # Hashes of one word, two, four and eight words; the last starts have no full window.
    for width in (1, 2, 4):
        counted = counted.withColumn("_hashes", F.transform("_hashes", hashed_with(width)))
    counted = counted.withColumn("_hashes", F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (SPAN - 1), F.lit(0))))
    hashes = F.col("_hashes")
    # Only texts with a repeated window are sorted.
    ordered = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.select(*[c for c in counted.columns if c != "_hashes"], ordered.alias("_sorted"))
    s = F.col("_sorted")
    repeated = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    counted = counted.select(*[c for c in counted.columns if c != "_sorted"],
                             F.sort_array(F.transform(repeated, lambda x: x["i"])).alias("_starts"))
    at = F.col("_starts")
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(SPAN), F.coalesce(F.get(at, k + 1) - x, F.lit(SPAN)))),
        F.lit(0), lambda total, x: total + x)
    counted = counted.select(*[c for c in counted.columns if c != "_starts"],
                             F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    n, chars = F.col("n_words"), F.col("word_chars")
    share = lambda c, whole: F.log1p(100.0 * F.col(c) / (whole + 20.0))
    return counted.withColumns({
        "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "f_length": F.log((chars + 5.0) / (n + 1.0)), "f_symbols": share("n_symbols", chars),
        "f_lines": share("n_dup_lines", n), "f_repeats": share("n_repeat_words", n)})


def chi2_below(x: float, freedom: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi2_limit(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, freedom) < share else (low, middle)
    return high


def least_spread(feature: str) -> float:
    """The spread at which the tolerated value alone lies at the limit."""
    value = TOLERATED[feature]
    reach = math.log(value) if feature == "f_length" else math.log1p(value)
    return reach / math.sqrt(chi2_limit(1 - TAIL, len(FEATURES)))


def group_quantile(rows: DataFrame, value: Column, share: float, steps: int) -> DataFrame:
    """Per ``g``, the smallest multiple of 1/steps that ``share`` of the rows do not exceed.

    Rows are counted per multiple first; only those counts are ordered.
    """
    counts = rows.groupBy("g", F.ceil(value * steps).alias("cell")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("g").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.select("g", "cell", F.sum("n").over(upto).alias("upto"), F.sum("n").over(W.partitionBy("g")).alias("all"))
    return ranked.where(F.col("upto") >= share * F.col("all")).groupBy("g").agg((F.min("cell") / steps).alias("limit"))


def squared_distance(p: int) -> Column:
    """Mahalanobis distance from the columns m0.., l00.. (centre, lower Cholesky factor) of the row's group."""
    solved: list[Column] = []
    for i, name in enumerate(FEATURES[:p]):
        rest = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        solved.append(rest / F.col(f"l{i}{i}"))
    return solved


def with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared distance from the estimate of the row's group ``g``."""
    joined = rows.join(sized(estimate, FEW_GROUPS), "g", "left")
    for i, solved in enumerate(squared_distance(len(FEATURES))):
        joined = joined.withColumn(f"y{i}", solved)
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(FEATURES))), F.col("y0") * F.col("y0"))
    return joined.withColumn("d2", d2).select(*rows.columns, "n", "d2")


def estimated(rows: DataFrame, widen: float) -> DataFrame:
    """Centre and Cholesky factor of the covariance (times ``widen``, plus the least spread) per ``g``."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.groupBy("g").agg(
        F.max("n").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in pairs])
    for i in range(p):
        for j in range(i + 1):
            held = F.col(f"c{i}{j}") * widen
            if i == j:
                held = held + least_spread(FEATURES[i]) ** 2
            for k in range(j):
                held = held - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            sums = sums.withColumn(f"l{i}{j}", F.sqrt(held) if i == j else held / F.col(f"l{j}{j}"))
    return sums.select("g", "n", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in pairs])


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per group ``g`` of rows with the four features.

    The first centre and spread are medians and median deviations; ``STEPS`` concentration
    steps and the usual reweighting follow. A group without rows has no estimate.
    """
    p = len(FEATURES)
    medians, spreads = None, None
    for i, f in enumerate(FEATURES):
        m = group_quantile(vectors, F.col(f), 0.5, 200).withColumnRenamed("limit", f"m{i}")
        medians = m if medians is None else medians.join(m, "g")
    medians = materialised_small(medians, "medians")
    around = vectors.join(sized(medians, FEW_GROUPS), "g")
    for i, f in enumerate(FEATURES):
        d = group_quantile(around, F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 200).select(
            "g", (F.col("limit") * 1.4826 + least_spread(f)).alias(f"l{i}{i}"))
        spreads = d if spreads is None else spreads.join(d, "g")
    counts = vectors.groupBy("g").agg(F.count("*").alias("n"))
    estimate = medians.join(spreads, "g").join(counts, "g").withColumns(
        {f"l{i}{j}": F.lit(0.0) for i in range(p) for j in range(i)})
    estimate = materialised_small(estimate, "start")
    inner = chi2_limit(KEPT_SHARE, p)
    widen = KEPT_SHARE / chi2_below(inner, p + 2)
    for _ in range(STEPS):
        measured = with_distance(vectors, estimate)
        limit = materialised_small(group_quantile(measured, F.log1p("d2"), KEPT_SHARE, 500), "limits")
        nearest = measured.join(sized(limit, FEW_GROUPS), "g").where(F.ceil(F.log1p("d2") * 500) / 500 <= F.col("limit"))
        estimate = materialised_small(estimated(nearest, widen), "step")
    share = 0.975
    close = chi2_limit(share, p)
    weighted = with_distance(vectors, estimate).where(F.col("d2") <= close)
    return materialised_small(estimated(weighted, share / chi2_below(close, p + 2)), "reweighted")


def judged(measured: DataFrame) -> DataFrame:
    """Adds ``d2`` and ``kept`` to rows of :func:`statistics` with ``lang`` and ``source``.

    Null languages or sources form groups of their own. Rows that fail the plain limits take
    no part in the estimates. Groups of fewer than ``MIN_GROUP`` such rows, or of none, are
    judged by the estimate over all groups; without any estimate the plain limits decide.
    """
    group = F.to_json(F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s")))
    rows = measured.withColumn("g", group)
    passing = rows.where(~F.col("base_failed"))
    vectors = passing.select("g", *FEATURES).unionByName(passing.select(F.lit("").alias("g"), *FEATURES))
    estimates = robust_estimates(vectors)
    groups = rows.select("g").distinct()
    own = estimates.where(F.col("n") >= MIN_GROUP)
    chosen = groups.join(own.select("g", F.lit(True).alias("_own")), "g", "left").select(
        "g", F.when(F.col("_own"), F.col("g")).otherwise("").alias("_from"))
    chosen = materialised_small(chosen.join(estimates.withColumnRenamed("g", "_from"), "_from", "left").drop("_from"), "chosen")
    limit = chi2_limit(1 - TAIL, len(FEATURES))
    return with_distance(rows, chosen).drop("g", "n").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, distance and kept.

    Repeated rows come out repeated; further columns are not looked at.
    """
    measured = statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    return judged(materialised(measured, "statistics")).select(
        "doc_id", *STATISTICS, "base_failed", "kept", F.col("d2").alias("distance2"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they came."""
    measured = materialised(statistics(with_row(docs, "text", "lang", "source")).drop("text", *STATISTICS), "statistics")
    return judged(measured).where("kept").select("_row.*")
