"""Coverage, cost, cohort and integrity reports over profiles and their logs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.functions.emails import report_email_type
from rollcall.functions.fixed_values import (
    FAILURE_PATTERNS,
    LOG_PATTERNS,
    REASON_CATEGORIES,
    SEARCH_PRICE,
    STATUSES,
    VENDOR_PRICE,
)
from rollcall.functions.names import name_bucket, org_flag
from rollcall.functions.text import first_filled, first_label, percent, text, trim_all
from rollcall.functions.urls import is_valid_profile_url
from rollcall.operators.intake import content_field_names, drop_junk, junk_count
from rollcall.operators.keyed import order_statistics, top_per_key


def _email_type() -> Column:
    return report_email_type(F.col("email"))


def _email_x_org() -> Column:
    return F.concat(_email_type(), F.lit("×"), F.when(trim_all(F.col("organization")) == "", "no-org").otherwise("has-org"))


def _input_quality() -> Column:
    kind, flag = _email_type(), F.when(trim_all(F.col("organization")) == "", "+no-org").otherwise("+org")
    return (
        F.when(kind.isin("no_email", "malformed"), "no-email")
        .when(kind == "personal", F.concat(F.lit("name+personal-email"), flag))
        .otherwise(F.concat(F.lit("name+corp-email"), flag))
    )


# The registry of cohort axes; callers may pass their own mapping of name to expression.
COHORT_AXES: dict[str, Callable[[], Column]] = {
    "email_type": _email_type,
    "org_presence": lambda: org_flag(F.col("organization")),
    "name_length": lambda: name_bucket(F.col("name")),
    "email_x_org": _email_x_org,
    "input_quality": _input_quality,
}


def status_report(people: DataFrame) -> DataFrame:
    """Count and share of every status; the total is summed over the few counted rows."""
    counts = people.groupBy(F.col("enrichment_status").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(W.partitionBy())))


def version_report(people: DataFrame) -> DataFrame:
    return people.groupBy(first_filled(F.col("enrichment_version"), F.lit("(none)")).alias("version")).agg(F.count("*").alias("n"))


def by_axis(people: DataFrame, axes: Mapping[str, Callable[[], Column]] | None = None) -> DataFrame:
    """One row per profile and cohort axis, with the bucket it falls in."""
    cells = [F.struct(F.lit(n).alias("axis"), build().alias("bucket")) for n, build in (axes or COHORT_AXES).items()]
    return people.select("*", F.inline(F.array(*cells)))


def cohort_status(people: DataFrame, axes: Mapping[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Bucket x status matrix with the enriched share, for every axis at once."""
    count = lambda s: F.count_if(F.col("enrichment_status") == s)
    grouped = by_axis(people, axes).groupBy("axis", "bucket").agg(
        F.count("*").alias("total"), *[count(s).alias(s) for s in STATUSES])
    return grouped.withColumn("enriched_pct", percent(F.col("enriched"), F.col("total")))


def source_presence(people: DataFrame, sources: Mapping[str, Column]) -> DataFrame:
    """How many profiles carry each source, among all and among the enriched."""
    done = F.col("enrichment_status") == "enriched"
    cells = F.array(*[F.struct(F.lit(n).alias("source"), has.alias("present")) for n, has in sources.items()])
    grouped = people.select(done.alias("done"), F.inline(cells)).groupBy("source").agg(
        F.count_if("present").alias("among_all"), F.count_if(F.col("present") & F.col("done")).alias("among_enriched"),
        F.count_if("done").alias("enriched_total"))
    return grouped.select("source", "among_all", "among_enriched",
                          percent(F.col("among_enriched"), F.col("enriched_total")).alias("among_enriched_pct"))


def log_pattern_counts(log_lines: DataFrame, patterns: list[tuple[str, str]] = LOG_PATTERNS) -> DataFrame:
    """Lines per pattern; a line counts for every pattern it contains. One row in, one pass."""
    sums = [F.count_if(F.contains(F.col("line"), F.lit(needle))).alias(name) for name, needle in patterns]
    return log_lines.agg(*sums).unpivot([], [n for n, _ in patterns], "event", "n").where("n > 0")


def log_costs(people: DataFrame, log_lines: DataFrame, search_price: float = SEARCH_PRICE, call_price: float = VENDOR_PRICE) -> DataFrame:
    """Searches, vendor calls and cost of every profile, zero where the log is silent."""
    counted = log_lines.groupBy("profile_id").agg(
        F.count_if(F.contains("line", F.lit("Search ("))).alias("searches"),
        F.count_if(F.contains("line", F.lit("Trying LinkedIn:"))).alias("vendor_calls"))
    joined = people.join(counted, people["id"] == counted["profile_id"], "left").drop("profile_id")
    priced = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("searches", "vendor_calls")})
    return priced.withColumn("cost", F.col("searches") * search_price + F.col("vendor_calls") * call_price)


def coverage_by_axis_with_cost(people: DataFrame, log_lines: DataFrame, axis: str = "email_type") -> DataFrame:
    """Coverage of one axis together with what it cost."""
    costed = by_axis(log_costs(people, log_lines), {axis: COHORT_AXES[axis]})
    count = lambda s: F.count_if(F.col("enrichment_status") == s)
    grouped = costed.groupBy("bucket").agg(
        F.count("*").alias("total"), *[count(s).alias(s) for s in STATUSES],
        F.sum("searches").alias("searches"), F.sum("vendor_calls").alias("vendor_calls"))
    cost = F.col("searches") * SEARCH_PRICE + F.col("vendor_calls") * VENDOR_PRICE
    return grouped.withColumns({
        "enriched_pct": percent(F.col("enriched"), F.col("total")), "cost_usd": F.round(cost, 4),
        "cost_per_profile": F.round(cost / F.col("total"), 4)})


# The one or two rows in the middle of n, from 0.
MIDDLE = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}


def cost_summary(costed: DataFrame) -> DataFrame:
    """Total, mean, median and nearest-rank p95 of the cost per profile; no row for no profiles."""
    counted = costed.groupBy(F.lit("all").alias("bucket"), F.round("cost", 9).alias("cost")).agg(
        F.count("*").alias("profiles"), F.sum("searches").alias("searches"), F.sum("vendor_calls").alias("vendor_calls"))
    sums = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("profiles", "searches", "vendor_calls")])
    picked = sums.join(order_statistics(counted, ["bucket"], "cost", "profiles", {
        **MIDDLE, "p95": lambda n: F.rint(F.lit(0.95) * (n - 1))}), "bucket")
    n = F.col("profiles")
    total = F.col("searches") * SEARCH_PRICE + F.col("vendor_calls") * VENDOR_PRICE
    return picked.select(
        "profiles", "searches", "vendor_calls", F.round(total, 4).alias("total_usd"),
        F.round(total / n, 4).alias("mean_usd"), F.round((F.col("low") + F.col("high")) / 2, 4).alias("p50_usd"),
        F.when(n >= 20, F.round("p95", 4)).alias("p95_usd"))


def decision_report(decisions: DataFrame) -> DataFrame:
    """Decisions, their reason categories and anchors as (section, bucket, n)."""
    reason = F.when(text("reason") == "", "unspecified").otherwise(
        first_label(F.col("reason"), REASON_CATEGORIES, "other", "prefix"))
    decision = first_filled(F.col("decision"), F.lit("unknown"))
    tag = lambda section, values: F.transform(values, lambda v: F.struct(F.lit(section).alias("section"), v.alias("bucket")))
    cells = F.concat(
        F.array(F.struct(F.lit("decision").alias("section"), decision.alias("bucket")),
                F.struct(F.lit("reason").alias("section"), F.concat(decision, F.lit(":"), reason).alias("bucket"))),
        tag("anchor_positive", F.col("anchors_positive")), tag("anchor_negative", F.col("anchors_negative")))
    return decisions.select(F.inline(cells)).groupBy("section", "bucket").agg(F.count("*").alias("n"))


def failure_reasons(log_lines: DataFrame, patterns: list[tuple[str, str]] = FAILURE_PATTERNS) -> DataFrame:
    """Distinct failure reasons per profile; the first pattern of a line decides."""
    labelled = log_lines.select("profile_id", first_label(F.col("line"), patterns, None).alias("reason"))
    return labelled.where("reason IS NOT NULL").distinct()


def top_failure_reasons(people: DataFrame, log_lines: DataFrame, k: int = 5,
                        axes: Mapping[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Most common failure reasons of failed and skipped profiles per cohort bucket."""
    lost = people.where(F.col("enrichment_status").isin("failed", "skipped"))
    reasons = failure_reasons(log_lines).join(lost, F.col("profile_id") == lost["id"])
    every = {**(axes or COHORT_AXES), "overall": lambda: F.lit("all")}
    counted = by_axis(reasons, every).groupBy("axis", "bucket", "reason").agg(F.count("*").alias("n"))
    return top_per_key(counted, ["axis", "bucket"], [F.desc("n"), F.asc("reason")], k)


def cohort_analysis(costed: DataFrame, axes: Mapping[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Every metric of every bucket of every axis, and of the whole, in one aggregation.

    ``costed`` comes from :func:`log_costs`, with a boolean ``wrong_person`` column where
    the audit has run.
    """
    wrong = F.col("wrong_person") if "wrong_person" in costed.columns else F.lit(False)
    every = {**(axes or COHORT_AXES), "overall": lambda: F.lit("all")}
    count = lambda s: F.count_if(F.col("enrichment_status") == s)
    # Rows are gone over once, to counts per cost; buckets and their medians come from these.
    counted = by_axis(costed, every).groupBy("axis", "bucket", F.round("cost", 9).alias("each_cost")).agg(
        F.count("*").alias("n"), *[count(s).alias(s) for s in STATUSES],
        F.count_if(wrong & (F.col("enrichment_status") == "enriched")).alias("wrong_person_n"),
        F.sum("searches").alias("searches"), F.sum("vendor_calls").alias("vendor_calls"))
    middle = order_statistics(counted, ["axis", "bucket"], "each_cost", "n", MIDDLE).select(
        "axis", "bucket", F.round((F.col("low") + F.col("high")) / 2, 4).alias("median_cost"))
    grouped = counted.groupBy("axis", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("n", *STATUSES, "wrong_person_n", "searches", "vendor_calls")]).join(middle, ["axis", "bucket"], "left")
    cost = F.col("searches") * SEARCH_PRICE + F.col("vendor_calls") * VENDOR_PRICE
    return grouped.withColumns({
        **{f"{s}_pct": percent(F.col(s), F.col("n")) for s in STATUSES},
        "wrong_person_pct": percent(F.col("wrong_person_n"), F.col("enriched")),
        "total_cost": F.round(cost, 4), "mean_cost": F.round(cost / F.col("n"), 4)})


def integrity(analysis: DataFrame, total_bucket: str = "overall") -> DataFrame:
    """Per axis: the bucket sum, and whether it equals the number of profiles."""
    sums = analysis.groupBy("axis").agg(F.sum("n").alias("sum_of_buckets"))
    total = F.max(F.when(F.col("axis") == total_bucket, F.col("sum_of_buckets"))).over(W.partitionBy())
    return sums.withColumn("matches_total", F.col("sum_of_buckets") == total).where(F.col("axis") != total_bucket)


def recommendations(analysis: DataFrame) -> DataFrame:
    """Which buckets call for action, and why: (rule, axis, bucket, n, rate)."""
    n, rate = F.col("n"), F.col("enriched_pct")
    mail = (F.col("axis") == "email_type") & (n >= 5)
    rule = (
        F.when(mail & (F.col("bucket") == "edu") & (rate < 50), "academic-coverage-low")
        .when(mail & (F.col("bucket") == "gov") & (rate >= 50), "public-sector-pages-pay")
        .when(mail & (F.col("bucket") == "personal") & (rate < 50), "personal-email-hardest")
        .when(mail & (F.col("bucket") == "corp"), "corporate-baseline")
        .when((F.col("axis") == "org_presence") & (F.col("bucket") == "no_org") & (n >= 5) & (rate < 20), "no-organisation-weak")
    )
    plain = analysis.select(rule.alias("rule"), "axis", "bucket", "n", rate.alias("rate")).where("rule IS NOT NULL")
    hot = analysis.where((F.col("axis") != "overall") & (n >= 10) & (F.col("wrong_person_pct") >= 10)).select(
        F.lit("wrong-person-hot-spot").alias("rule"), "axis", "bucket", "n", F.col("wrong_person_pct").alias("rate"))
    worst = analysis.where((F.col("axis") == "input_quality") & (n >= 5)).agg(
        F.min_by(F.struct("axis", "bucket", "n", rate.alias("rate")), F.struct(rate, "bucket")).alias("w")).select(
        F.lit("hardest-input").alias("rule"), "w.axis", "w.bucket", "w.n", "w.rate").where("axis IS NOT NULL")
    return plain.unionByName(hot).unionByName(worst)


def upload_statistics(people: DataFrame) -> DataFrame:
    """What an upload brings: usable URLs, e-mail only, no signal."""
    url, mail = is_valid_profile_url(F.col("linkedin_url")), text("email") != ""
    return people.agg(
        F.count("*").alias("total"), F.count_if(url).alias("have_url"), F.count_if(mail & ~url).alias("email_only"),
        F.count_if(~mail & ~url).alias("no_signal"), F.count_if(F.col("enrichment_status") == "enriched").alias("already_enriched"))


def upload_summary(profiles: DataFrame, duplicates: DataFrame) -> DataFrame:
    """What came of an upload, one row: URLs, e-mail only, searchable fields, skipped rows, matches with known people.

    ``profiles``: all mapped rows, junk included. ``duplicates``: :func:`dedup.find_duplicates`.
    """
    kept = drop_junk(profiles)
    parts = [
        upload_statistics(kept.withColumn("enrichment_status", F.lit(""))).drop("already_enriched", "no_signal"),
        content_field_names(kept).agg(
            F.count("*").alias("content_fields"), F.array_join(F.array_sort(F.collect_set("field_name")), ",").alias("content_field_names")),
        junk_count(profiles).select("skipped_rows"),
        duplicates.agg(F.coalesce(F.sum("n_existing"), F.lit(0)).alias("duplicates"))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def cost_estimate(stats: DataFrame, call_price: float = 0.01, lookup_price: float = 0.005, hit_rate: float = 0.8) -> DataFrame:
    """Price of a run before it starts, from :func:`upload_statistics`."""
    lookups = F.col("email_only")
    calls = F.greatest(F.lit(0), F.col("have_url") - F.col("already_enriched")) + F.floor(lookups * hit_rate)
    priced = stats.select(
        lookups.alias("lookups"), calls.alias("vendor_calls"), F.round(lookups * lookup_price, 6).alias("lookup_usd"),
        F.round(calls * call_price, 6).alias("vendor_usd"))
    total = F.round(F.col("lookup_usd") + F.col("vendor_usd"), 6)
    return priced.withColumns({
        "total_usd": total, "warning": F.when(total > 100, "large").when(total > 10, "significant").otherwise("")})


def run_statistics(results: DataFrame, state: str = "state") -> DataFrame:
    """Profiles and cost per final state of a batch."""
    return results.groupBy(state).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


def long_report(sections: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Stack reports as (section, bucket, metric, value) for table, JSON or text sinks."""
    stacked = None
    for section, (df, bucket) in sections.items():
        metrics = [c for c in df.columns if c != bucket]
        one = df.select(F.col(bucket).cast("string").alias("bucket"), *[F.col(m).cast("double").alias(m) for m in metrics])
        one = one.unpivot(["bucket"], metrics, "metric", "value").withColumn("section", F.lit(section))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.select("section", "bucket", "metric", "value")


def markdown_lines(report: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """A report of any length as the lines of a Markdown table: place (0 head, 1 rule, 2 row), line.

    With ``order`` rows have their sort values beside them, in ``at``. Bars in cells are
    escaped, line breaks become spaces.
    """
    shown = lambda c: F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    cells = [shown(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in report.columns]
    at = [F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("at")] if order else []
    rows = report.select(F.lit(2).alias("place"), *at, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(c.replace("|", "\\|") for c in report.columns) + " |"), (1, "|" + " --- |" * len(report.columns))]
    return report.sparkSession.createDataFrame(head, "place int, line string").unionByName(rows, allowMissingColumns=True)


def write_markdown(report: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """The lines in the order of the given columns (ascending), or of their text where none are given."""
    lines = markdown_lines(report, order)
    lines.orderBy("place", *(["at"] if order else []), "line").select("line").write.mode("overwrite").text(path)
