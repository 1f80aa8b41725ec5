"""What the columns of an upload mean: sampled values, name patterns, value shapes.

The pass over the data is one Spark job for all columns. Its result has one row per
column; because an identity kind may be used once only, the choice walks those few rows
in column order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import COLUMN_PATTERNS, FIELD_TIERS, LONG_TEXT
from rollcall.functions.names import looks_like_person
from rollcall.functions.text import first_label, snake_case, text
from rollcall.operators.keyed import top_per_key

SAMPLE_ROWS, SAMPLES = 20, 3


@dataclass(frozen=True)
class FieldMapping:
    source_column: str
    field_type: str
    target_name: str
    sample_values: tuple[str, ...]
    confidence: float


def column_samples(df: DataFrame, position: str, columns: list[str] | None = None) -> DataFrame:
    """First three non-empty values among the first twenty rows, per column.

    The first rows are a top-k by position, so nothing but them leaves the scan.
    """
    names = columns or [c for c in df.columns if c != position]
    head = df.select(position, *[text(F.col(f"`{c}`").cast("string")).alias(c) for c in names]).orderBy(position).limit(SAMPLE_ROWS)
    cells = head.unpivot([position], [f"`{c}`" for c in names], "source_column", "value").where("value <> ''")
    kept = top_per_key(cells, ["source_column"], [F.asc(position)], SAMPLES)
    return kept.groupBy("source_column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples"))


def name_type(name: Column) -> Column:
    """Kind suggested by the column name alone; null when no pattern fits."""
    return first_label(name, COLUMN_PATTERNS, None, "regex")


def target_name(name: Column, kind: Column) -> Column:
    fixed = F.regexp_extract(kind, "^identity_(.*)$", 1)
    return F.when(fixed != "", fixed).otherwise(snake_case(name))


def field_tier(name: Column, body: Column) -> Column:
    """How much a content field is worth, by name, else by length."""
    by_name = first_label(name, FIELD_TIERS, None, "regex")
    return F.coalesce(by_name, F.when(F.length(body) > LONG_TEXT, "self_reported").otherwise("first_person"))


def describe_samples(samples: DataFrame) -> DataFrame:
    """Facts about each column that typing needs: matching name patterns, value shapes."""
    s = F.col("samples")
    low = F.transform(s, F.lower)
    every = lambda test: F.forall(s, test)
    every_low = lambda pattern: F.forall(low, lambda v: v.rlike(pattern))
    profile_text = F.exists(low, lambda v: (F.length(v) > 100) & v.rlike("experience|education|headline"))
    patterns = F.array_compact(F.array(*[F.when(F.col("source_column").rlike(p), F.lit(i)) for i, (p, _) in enumerate(COLUMN_PATTERNS)]))
    lengths = F.transform(s, F.length)
    return samples.select(
        "source_column", "samples", patterns.alias("patterns"),
        F.exists(low, lambda v: F.contains(v, F.lit("linkedin.com"))).alias("any_profile_url"), profile_text.alias("profile_text"),
        F.exists(s, lambda v: F.contains(v, F.lit("@"))).alias("any_at"), every(looks_like_person).alias("all_names"),
        every(lambda v: v.rlike(r"^[^@]+@[^@]+\.[^@]+")).alias("all_emails"), every_low("linkedin[.]com").alias("all_profile_urls"),
        every(lambda v: v.rlike("^https?://")).alias("all_urls"), every_low(r"twitter\.com|x\.com").alias("all_twitter"),
        every_low(r"drive\.google\.com|docs\.google\.com|dropbox\.com").alias("all_resume"),
        every_low(r"github\.com|gitlab\.com").alias("all_code"),
        every(lambda v: F.trim(v).rlike(r"^[\d\s\-\+\(\)]{7,15}$")).alias("all_phones"),
        (F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(s), F.lit(1))).alias("mean_length"),
        F.coalesce(F.array_max(lengths), F.lit(0)).alias("max_length"))


def value_type(described: DataFrame) -> DataFrame:
    """Kind and confidence from the values alone, with no kind used up yet."""
    row = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    c = F.col
    kind = (
        F.when(F.size("samples") == 0, row("metadata", 0.3)).when(c("all_names"), row("identity_name", 0.7))
        .when(c("all_emails"), row("identity_email", 0.8)).when(c("all_profile_urls"), row("identity_linkedin", 0.8))
        .when(c("all_urls") & c("all_twitter"), row("link_twitter", 0.8)).when(c("all_urls") & c("all_resume"), row("link_resume", 0.7))
        .when(c("all_urls") & c("all_code"), row("link_other", 0.7)).when(c("all_urls"), row("link_website", 0.5))
        .when(c("all_phones"), row("identity_phone", 0.7)).when(c("mean_length") > 200, row("content", 0.7))
        .when(c("mean_length") < 30, row("metadata", 0.5)).when(c("max_length") > 50, row("content", 0.5))
        .otherwise(row("metadata", 0.3))
    )
    return described.withColumn("_k", kind).select("*", "_k.kind", "_k.confidence").drop("_k")


def _choose(facts, used: set[str]) -> tuple[str, float]:
    """Kind of one column given the identity kinds already taken."""
    some = bool(facts["samples"])
    for index in facts["patterns"]:
        kind = COLUMN_PATTERNS[index][1]
        taken = kind in used
        if kind == "identity_linkedin" and some and (taken or not facts["any_profile_url"]):
            if facts["profile_text"]:
                return "linkedin_text", 0.85
            continue
        if taken and kind != "identity_name":
            continue
        if kind == "identity_email" and some and not facts["any_at"]:
            continue
        return kind, 0.9
    if some:
        for test, kind, sure in (
            ("all_names", "identity_name", 0.7), ("all_emails", "identity_email", 0.8),
            ("all_profile_urls", "identity_linkedin", 0.8),
        ):
            if facts[test] and kind not in used:
                return kind, sure
        if facts["all_urls"]:
            for test, kind, sure in (("all_twitter", "link_twitter", 0.8), ("all_resume", "link_resume", 0.7), ("all_code", "link_other", 0.7)):
                if facts[test]:
                    return kind, sure
            return "link_website", 0.5
        if facts["all_phones"] and "identity_phone" not in used:
            return "identity_phone", 0.7
        if facts["mean_length"] > 200:
            return "content", 0.7
        if facts["mean_length"] < 30:
            return "metadata", 0.5
    return ("content", 0.5) if facts["max_length"] > 50 else ("metadata", 0.3)


def detect_columns(df: DataFrame, position: str) -> list[FieldMapping]:
    """Field mappings of an upload, in column order. One row per column reaches the driver."""
    names = [c for c in df.columns if c != position]
    headers = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(names)], "col_no INT, source_column STRING")
    sampled = headers.join(column_samples(df, position, names), "source_column", "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<string>")))
    facts = describe_samples(sampled).join(headers, "source_column").orderBy("col_no").withColumn(
        "snake", snake_case(F.col("source_column"))).collect()
    used: set[str] = set()
    mappings = []
    for row in facts:
        kind, sure = _choose(row, used)
        identity = kind.startswith("identity_")
        if identity:
            used.add(kind)
        target = kind.removeprefix("identity_") if identity else row["snake"]
        mappings.append(FieldMapping(row["source_column"], kind, target, tuple(row["samples"]), sure))
    return mappings


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill rate, distinct estimate, mean length and shape shares over the whole table."""
    names = columns or df.columns
    shapes = {"email_share": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "url_share": "^https?://", "number_share": r"^-?\d+(\.\d+)?$"}
    n = F.count("*")

    def facts(name: str) -> Column:
        value = text(F.col(f"`{name}`").cast("string"))
        filled = value != ""
        share = lambda test: F.round(F.count_if(test) / n, 6)
        return F.struct(
            F.lit(name).alias("source_column"), share(filled).alias("fill_rate"),
            F.approx_count_distinct(F.when(filled, value)).alias("approx_distinct"),
            F.round(F.coalesce(F.avg(F.when(filled, F.length(value))), F.lit(0.0)), 6).alias("mean_length"),
            *[share(filled & value.rlike(p)).alias(k) for k, p in shapes.items()])

    return df.agg(F.array(*[facts(c) for c in names]).alias("all")).select(F.inline("all"))


