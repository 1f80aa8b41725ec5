"""Verification attempts rebuilt from log lines, and what-if replay of their outcome.

``log_lines`` has one row per line: profile_id, pos (integer, unique in a profile), line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import STATUSES
from rollcall.functions.text import guarded_ratio, text
from rollcall.functions.urls import profile_slug
from rollcall.operators.keyed import first_per_key, running_sums
from rollcall.session import cut_lineage

# Tunables of the acceptance rule and their defaults.
REPLAY_DEFAULTS: dict[str, int | bool] = {
    "name_strong_score": 3, "name_normal_score": 2, "name_weak_score": 1,
    "org_match_score": 3, "org_mismatch_penalty": 1,
    "location_match_score": 2, "location_mismatch_penalty": 1,
    "content_match_score": 2, "content_weak_penalty": 1, "slug_anchor_score": 0,
    "baseline_threshold": 2, "require_anchors": 0,
    "reject_on_weak_name_no_positive": True, "reject_on_penalty_no_positive": True,
    "honor_weak_match_hard_reject": True, "honor_name_mismatch_hard_reject": True,
}

_FLAGS = {
    "name_mismatch": "Verify name: MISMATCH", "name_weak_rejected": "Verify name: WEAK-MATCH REJECTED",
    "org_match": "Verify org: MATCH", "org_mismatch": "Verify org: MISMATCH",
    "location_match": "Verify location: MATCH", "location_mismatch": "Verify location: MISMATCH",
    "content_match": "Verify content relevance: MATCH", "content_weak": "Verify content relevance: WEAK",
}


def _says(needle: str) -> Column:
    return F.contains(F.col("line"), F.lit(needle))


def telling() -> Column:
    """Whether a line says something about an attempt; the others are kept out of every shuffle."""
    return _says("Trying LinkedIn:") | _says("Verify ") | _says("API returned no data")


def mark_lines(log_lines: DataFrame) -> DataFrame:
    """Lines with what they do to an attempt: open it, close it, or carry a signal."""
    opened = F.regexp_extract("line", r"Trying LinkedIn:\s*(\S+)", 1)
    strength = F.regexp_extract("line", r"Verify name: MATCH.*?strength=(\w+)", 1)
    about_name = _says("Verify name: MISMATCH") | _says("Verify name: WEAK-MATCH REJECTED") | (strength != "")
    closing = (
        F.when(_says("Verify result: ACCEPTED"), "accepted").when(_says("Verify result: REJECTED"), "rejected")
        .when(_says("API returned no data"), "no_data")
    )
    return log_lines.withColumns({
        "url": F.when(opened != "", F.regexp_replace(opened, "/+$", "")),
        "strength": F.when(strength != "", F.lower(strength)),
        "closing": F.when((opened == "") & ~about_name, closing),
    })


def with_attempt_numbers(log_lines: DataFrame, chunk: int = 65536) -> DataFrame:
    """Marked lines with attempt_no and the number of closing lines seen before each."""
    counted = running_sums(
        mark_lines(log_lines), ["profile_id"], "pos",
        {"attempt_no": F.col("url").isNotNull(), "closed": F.col("closing").isNotNull()}, chunk)
    return counted.withColumn("closed_before", F.col("closed") - F.col("closing").isNotNull().cast("long")).drop("closed", "closed_total")


def parse_attempts(log_lines: DataFrame, chunk: int = 65536) -> DataFrame:
    """One row per attempt with its signals and stored decision.

    Lines of an attempt share the count of earlier closing lines with its opening line
    until the first closing line, so the live part is one aggregate group.
    """
    lines = with_attempt_numbers(log_lines.where(telling()), chunk)
    closing_line = F.max(F.when(F.col("closing").isNotNull(), F.col("line")))
    flags = {name: F.bool_or(_says(needle)) for name, needle in _FLAGS.items()}
    grouped = lines.where("attempt_no > 0").groupBy("profile_id", "attempt_no", "closed_before").agg(
        F.min("pos").alias("pos"), F.max("url").alias("url"),
        F.coalesce(F.max_by("strength", F.when(F.col("strength").isNotNull(), F.col("pos"))), F.lit("none")).alias("name_strength"),
        *[f.alias(n) for n, f in flags.items()],
        F.max("closing").alias("closing"), F.coalesce(closing_line, F.lit("")).alias("closing_line"),
        F.max("attempt_no_total").alias("newest"))
    live = grouped.where(F.col("url").isNotNull())
    number = lambda pattern: F.coalesce(
        F.nullif(F.regexp_extract("closing_line", pattern, 1), F.lit("")).cast("int"), F.lit(0))
    line = F.col("closing_line")
    legacy = (
        F.when(F.col("closing") == "accepted", ~line.rlike("name=|positives="))
        .when(F.col("closing") == "rejected", ~line.rlike("penalties=|corroborating|weak name match"))
        .otherwise(False)
    )
    decision = F.coalesce(
        F.col("closing"), F.when(F.col("name_mismatch") | F.col("name_weak_rejected"), F.lit("rejected")),
        F.when(F.col("attempt_no") == F.col("newest"), F.lit("no_data")), F.lit("unknown"))
    return live.select(
        "profile_id", "attempt_no", "pos", "url", "name_strength", *_FLAGS,
        decision.alias("stored_decision"), number(r"score=(-?\d+)").alias("raw_score"),
        number(r"checks=(\d+)").alias("raw_checks"), legacy.alias("legacy_log_format"))


def with_slug_anchor(attempts: DataFrame, people: DataFrame) -> DataFrame:
    """Adds slug_anchor: both outer names occur in the URL's slug."""
    parts = F.split(F.trim(text("name")), r"\s+")
    outer = people.select(
        F.col("id").alias("profile_id"),
        F.when(F.size(parts) > 1, F.lower(F.get(parts, 0))).alias("_first"),
        F.when(F.size(parts) > 1, F.lower(F.get(parts, F.size(parts) - 1))).alias("_last"))
    slug = F.regexp_replace(profile_slug(F.col("url")), r"[-_.]", "")
    hit = (slug != "") & F.contains(slug, F.col("_first")) & F.contains(slug, F.col("_last"))
    return attempts.join(outer, "profile_id", "left").withColumn(
        "slug_anchor", F.coalesce(hit, F.lit(False))).drop("_first", "_last")


def _configs(configs: Mapping[str, Mapping]) -> Column:
    """Named settings as an array of structs; a few rows that travel inside the plan."""
    return F.array(*[
        F.struct(F.lit(name).alias("config"), *[
            F.lit({**REPLAY_DEFAULTS, **given}[k]).alias(k) for k in REPLAY_DEFAULTS])
        for name, given in configs.items()])


def replay_attempts(attempts: DataFrame, configs: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Outcome of every attempt that reached the verifier, under every named config."""
    if "slug_anchor" not in attempts.columns:
        attempts = attempts.withColumn("slug_anchor", F.lit(False))
    ran = attempts.where("stored_decision <> 'no_data'").withColumn("cfg", F.explode(_configs(configs or {"default": {}})))
    cfg = lambda key: F.col(f"cfg.{key}")
    zero = F.lit(0)
    slug = F.col("slug_anchor") & (cfg("slug_anchor_score") != 0)

    def pair(match: str, miss: str, plus: str, minus: str) -> Column:
        return F.when(F.col(match), cfg(plus)).when(F.col(miss), -cfg(minus)).otherwise(zero)

    score = (
        F.when(F.col("name_strength") == "strong", cfg("name_strong_score"))
        .when(F.col("name_strength") == "normal", cfg("name_normal_score"))
        .when(F.col("name_strength") == "weak", cfg("name_weak_score")).otherwise(zero)
        + pair("org_match", "org_mismatch", "org_match_score", "org_mismatch_penalty")
        + pair("location_match", "location_mismatch", "location_match_score", "location_mismatch_penalty")
        + pair("content_match", "content_weak", "content_match_score", "content_weak_penalty")
        + F.when(slug, cfg("slug_anchor_score")).otherwise(zero)
    )
    count = lambda c: c.cast("int")
    positives = sum((count(F.col(c)) for c in ("org_match", "location_match", "content_match")), count(slug))
    misses = [("org_match", "org_mismatch"), ("location_match", "location_mismatch"), ("content_match", "content_weak")]
    penalties = sum((count(~F.col(a) & F.col(b)) for a, b in misses), F.lit(0))
    scored = ran.withColumns({"score": score, "positives": positives, "penalties": penalties})
    alone = F.col("positives") == 0
    reason = (
        F.when(cfg("honor_name_mismatch_hard_reject") & F.col("name_mismatch"), "name-mismatch")
        .when(cfg("honor_weak_match_hard_reject") & F.col("name_weak_rejected"), "weak-match-reject")
        .when(F.col("name_strength") == "none", "no-name-signal")
        .when(F.col("score") < cfg("baseline_threshold"), F.concat(F.lit("score<"), cfg("baseline_threshold").cast("string")))
        .when((cfg("require_anchors") > 0) & (F.col("positives") < cfg("require_anchors")),
              F.concat(F.lit("<"), cfg("require_anchors").cast("string"), F.lit("-positive-anchors")))
        .when(cfg("reject_on_weak_name_no_positive") & (F.col("name_strength") == "weak") & alone, "weak-name-no-positive")
        .when(cfg("reject_on_penalty_no_positive") & (F.col("penalties") > 0) & alone, "penalty-no-positive")
        .otherwise("accepted")
    )
    return scored.select(
        "profile_id", cfg("config").alias("config"), "attempt_no", "url", "score", "positives", "penalties",
        reason.alias("reason"), (reason == "accepted").alias("accepted"))


def replay_profiles(attempts: DataFrame, configs: Mapping[str, Mapping] | None = None) -> DataFrame:
    """First accepted attempt per profile and config, else the first failure."""
    outcomes = replay_attempts(attempts, configs)
    picked = first_per_key(
        outcomes.withColumn("turn", F.when(F.col("accepted"), 0).otherwise(1)),
        ["profile_id", "config"], ["turn", "attempt_no"], ["accepted", "url", "score", "reason"])
    return picked.select(
        "profile_id", "config", F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("replay_decision"),
        "url", "score", "reason")


def stored_decisions(people: DataFrame, attempts: DataFrame) -> DataFrame:
    """Profile-level decision implied by the status and whether attempts exist."""
    tried = attempts.groupBy("profile_id").agg(
        F.count("*").alias("attempts"), F.bool_or("legacy_log_format").alias("legacy"),
        F.min_by("url", F.when(F.col("stored_decision") == "accepted", F.col("attempt_no"))).alias("stored_url"))
    status = F.when(F.col("enrichment_status").isin(STATUSES), F.col("enrichment_status")).otherwise("pending")
    n = F.coalesce("attempts", F.lit(0))
    decision = (
        F.when(status == "enriched", "accepted").when((status == "failed") & (n > 0), "rejected")
        .when(status == "skipped", "skipped").otherwise("no_attempt")
    )
    return people.select(F.col("id").alias("profile_id"), "enrichment_status").join(tried, "profile_id", "left").select(
        "profile_id", decision.alias("stored_decision"), n.alias("attempts"),
        F.coalesce("legacy", F.lit(False)).alias("legacy"), F.coalesce("stored_url", F.lit("")).alias("stored_url"))


def compare_replay(people: DataFrame, attempts: DataFrame, configs: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Stored against replayed decision of every profile, per config."""
    names: Sequence[str] = list(configs or {"default": {}})
    attempts = cut_lineage(attempts)  # read twice below, far smaller than the log
    stored = stored_decisions(people, attempts).withColumn("config", F.explode(F.array(*[F.lit(n) for n in names])))
    replayed = replay_profiles(attempts, configs)
    both = stored.join(replayed, ["profile_id", "config"], "left").withColumn(
        "replay_decision", F.coalesce("replay_decision", F.lit("no_attempt")))
    judged = F.col("stored_decision").isin("accepted", "rejected") & F.col("replay_decision").isin("accepted", "rejected")
    return both.withColumn("flipped", judged & (F.col("stored_decision") != F.col("replay_decision")))


def replay_confusion(compared: DataFrame) -> DataFrame:
    return compared.groupBy("config", "stored_decision", "replay_decision").agg(F.count("*").alias("n"))


def replay_summary(compared: DataFrame) -> DataFrame:
    """Totals per config and the check that they add up."""
    hit = lambda d: F.count_if(F.col("replay_decision") == d)
    return compared.groupBy("config").agg(
        F.count("*").alias("total"), hit("accepted").alias("would_accept"), hit("rejected").alias("would_reject"),
        hit("no_attempt").alias("uncompared"), F.count_if("flipped").alias("flips"),
        (hit("accepted") + hit("rejected") + hit("no_attempt") == F.count("*")).alias("sum_check_ok"))


def roundtrip(compared: DataFrame) -> DataFrame:
    """How well the default rule reproduces what was stored, with and without old log forms."""
    ran = F.col("replay_decision").isin("accepted", "rejected")
    current = ran & F.col("stored_decision").isin("accepted", "rejected") & ~F.col("legacy")
    counted = compared.groupBy("config").agg(
        F.count_if(ran).alias("compared"), F.count_if("flipped").alias("mismatches"),
        F.count_if(current).alias("compared_current"), F.count_if(current & ~F.col("flipped")).alias("matches_current"),
        F.count_if(F.col("flipped") & F.col("legacy")).alias("legacy_flips_ignored"))

    def rate(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, F.lit(1.0)).otherwise(F.round(guarded_ratio(part, whole), 4))

    return counted.withColumns({
        "reproducibility_rate": rate(F.col("compared") - F.col("mismatches"), F.col("compared")),
        "reproducibility_rate_current": rate(F.col("matches_current"), F.col("compared_current"))})


def tied_candidates(log_lines: DataFrame) -> DataFrame:
    """Scored candidates written to the log: profile_id, pos, score, url, reasons."""
    pattern = r"^\s*\[\s*(-?\d+)\]\s+(https?://\S+)\s+\((.*)\)\s*$"
    found = log_lines.where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return found.select(
        "profile_id", "pos", part(1).cast("int").alias("score"), F.regexp_replace(part(2), "/+$", "").alias("url"),
        F.transform(F.split(part(3), ","), lambda r: F.trim(r)).alias("reasons"))


def tie_signatures(log_lines: DataFrame) -> DataFrame:
    """First tie announced in each profile's log."""
    pattern = r"(\d+)\s+candidates tied at score\s+(-?\d+)"
    ties = log_lines.where(F.col("line").rlike(pattern)).select(
        "profile_id", "pos", F.regexp_extract("line", pattern, 1).cast("int").alias("tie_count"),
        F.regexp_extract("line", pattern, 2).cast("int").alias("tie_score"))
    return first_per_key(ties, ["profile_id"], ["pos"], ["tie_count", "tie_score"])
