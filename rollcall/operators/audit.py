"""Wrong-person audit, clean-up of overwritten fields, arbiter comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.names import (
    audit_last,
    audit_tokens,
    canonical_first_name,
    loose_key,
    token_overlap,
    tokens_match,
)
from rollcall.functions.text import first_filled, guarded_ratio, let, text, trim_all
from rollcall.operators.keyed import top_per_key
from rollcall.session import cut_lineage
from rollcall.sources.uploads import index_source_rows

# A starting set of first names used for one another. Pass a larger table
# with columns name and group_id where more are known; a name may sit in several groups.
ALIAS_GROUPS = [
    ["alex", "alexander", "alexandra"], ["andy", "drew", "andrew"], ["ben", "benjamin"], ["beth", "liz", "elizabeth"],
    ["bob", "rob", "robert"], ["charlie", "chuck", "charles"], ["chris", "christopher", "christine"], ["dan", "daniel"],
    ["dave", "david"], ["ed", "ted", "edward"], ["ted", "theo", "theodore"], ["greg", "gregory"], ["jack", "john", "jonathan"],
    ["jen", "jenny", "jennifer"], ["jim", "james"], ["joe", "joseph"], ["kate", "katherine", "catherine"], ["ken", "kenneth"],
    ["matt", "matthew"], ["meg", "maggie", "margaret"], ["mike", "michael"], ["nick", "nicholas"], ["pat", "patrick", "patricia"],
    ["pete", "peter"], ["rick", "dick", "richard"], ["sam", "samuel", "samantha"], ["steve", "steven", "stephen"], ["sue", "susan"],
    ["tim", "timothy"], ["tom", "thomas"], ["tony", "anthony"], ["will", "bill", "william"], ["zach", "zachary"],
]


def alias_table(spark) -> DataFrame:
    rows = [(name, i) for i, group in enumerate(ALIAS_GROUPS) for name in group]
    return spark.createDataFrame(rows, "name STRING, group_id INT")


def alias_forms(aliases: DataFrame) -> DataFrame:
    """All names of all groups a name belongs to: name, forms."""
    groups = aliases.groupBy("group_id").agg(F.collect_set("name").alias("names"))
    return aliases.join(groups, "group_id").select("name", F.explode("names").alias("form")).groupBy("name").agg(
        F.collect_set("form").alias("forms"))


def with_forms(df: DataFrame, name: Column, aliases: DataFrame, out: str) -> DataFrame:
    """Adds the alias forms of a first name; an unknown name stands for itself."""
    forms = alias_forms(aliases).select(F.col("name").alias("_alias"), F.col("forms").alias("_forms"))
    keyed = df.withColumn("_alias", canonical_first_name(name))
    return keyed.join(forms, "_alias", "left").withColumn(
        out, F.when(F.col("_alias") == "", F.array().cast("array<string>")).otherwise(F.coalesce("_forms", F.array("_alias")))
    ).drop("_alias", "_forms")


def audit_pairs(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Suspicious matches among enriched profiles.

    ``pairs``: profile_id, uploaded_name, full_name and optionally context_block, whose
    ``Name:`` line is used where full_name is empty.
    """
    line = F.regexp_extract(text("context_block"), r"(?m)^\s*Name:\s*(.+)$", 1) if "context_block" in pairs.columns else F.lit("")
    named = pairs.withColumns({
        "uploaded_name": trim_all(F.col("uploaded_name")), "enriched_name": first_filled(trim_all(F.col("full_name")), trim_all(line))})
    named = named.withColumns({"_a": audit_tokens(F.col("uploaded_name")), "_b": audit_tokens(F.col("enriched_name"))}).where(
        (F.size("_a") > 0) & (F.size("_b") > 0))
    named = with_forms(named, F.get("_a", 0), aliases, "_fa")
    named = with_forms(named, F.get("_b", 0), aliases, "_fb")
    scored = named.withColumns({
        "overlap": token_overlap(F.col("_a"), F.col("_b"), F.arrays_overlap("_fa", "_fb")),
        "a_last": audit_last(F.col("_a")), "b_last": audit_last(F.col("_b")), "_single": F.size("_a") == 1})
    differ = (F.col("a_last") != "") & (F.col("b_last") != "") & ~tokens_match(F.col("a_last"), F.col("b_last"))
    flags = F.array_compact(F.array(
        F.when(differ, F.when(F.col("_single"), "single_token_uploaded_name").otherwise("different_last_name")),
        F.when(F.col("overlap") == 0, "no_shared_tokens").when(
            (F.col("overlap") < 0.5) & ~F.col("_single"), "token_overlap_below_50pct")))
    return scored.withColumn("flags", flags).where(F.size("flags") > 0).select(
        "profile_id", "uploaded_name", "enriched_name", F.round("overlap", 3).alias("overlap"), "a_last", "b_last", "flags")


def audit_sample(people: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """Enriched profiles to audit: all, or ``n`` chosen by a seeded digest of the id."""
    enriched = people.where(F.col("enrichment_status") == "enriched")
    return enriched if n is None else enriched.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), "id").limit(n)


def audit_summary(audited: DataFrame, suspects: DataFrame, population: int | None = None) -> DataFrame:
    """Suspect rates of an audit; ``population`` is the number enriched where a sample was audited."""
    weak = F.array_contains("flags", F.lit("single_token_uploaded_name"))
    flagged = audited.select(F.col("id").alias("profile_id")).join(suspects.select("profile_id", weak.alias("weak")), "profile_id", "left")
    found = F.col("weak").isNotNull()
    counts = flagged.agg(
        F.count("*").alias("sample_size"), F.count_if(found).alias("suspects"), F.count_if(found & ~F.col("weak")).alias("strong_suspects"),
        F.count_if(F.col("weak")).alias("weak_suspects"))
    whole = F.col("sample_size") if population is None else F.lit(population)
    strong = guarded_ratio(F.col("strong_suspects"), F.col("sample_size"))
    return counts.withColumns({
        "rate_lower_bound": F.round(strong, 4), "rate_including_weak": F.round(guarded_ratio(F.col("suspects"), F.col("sample_size")), 4),
        "projected_suspects": F.rint(strong * whole).cast("long")})


# --- clean-up --------------------------------------------------------------------------------
def _same(a: Column, b: Column) -> Column:
    return (loose_key(a) != "") & (loose_key(a) == loose_key(b))


def field_fix(current: Column, vendor: Column, source: Column, suspect: Column) -> Column:
    """What to do with one field: struct(reason, value); a null value leaves it alone.

    ``source`` is null where the original upload has no row for the profile.
    """
    now, theirs, own = text(current), text(vendor), trim_all(source)
    copied = (now != "") & _same(now, theirs)

    def out(reason: str, value: Column | None = None) -> Column:
        return F.struct(F.lit(reason).alias("reason"), (F.lit(None).cast("string") if value is None else value).alias("value"))

    return (
        F.when(source.isNotNull() & (own != "") & ~_same(own, now), out("restored-from-source", own))
        .when(source.isNotNull() & (own != ""), out("matches-source-already"))
        .when(source.isNotNull() & copied, out("source-blank-current-matches-enriched", F.when(suspect, F.lit(""))))
        .when(source.isNotNull(), out("source-blank-current-differs"))
        .when(copied & (theirs != "") & suspect, out("blanked-suspect-matches-enriched", F.lit("")))
        .when(copied & (theirs != ""), out("nonsuspect-matches-enriched-keep"))
        .when((now == "") & (theirs != "") & suspect, out("already-empty-suspect"))
        .otherwise(out("unchanged-differs-from-enriched"))
    )


def with_source_rows(people: DataFrame, rows: DataFrame) -> DataFrame:
    """Original organisation and title per profile: by e-mail, else by name."""
    by_mail = index_source_rows(rows, loose_key(F.col("email"))).select(
        F.col("source_key").alias("_mail"), F.struct("organization", "title").alias("_by_mail"))
    by_name = index_source_rows(rows, loose_key(F.col("name"))).select(
        F.col("source_key").alias("_name"), F.struct("organization", "title").alias("_by_name"))
    keyed = people.withColumns({"_mail": loose_key(F.col("email")), "_name": loose_key(F.col("name"))})
    found = F.coalesce("_by_mail", "_by_name")
    return keyed.join(by_mail, "_mail", "left").join(by_name, "_name", "left").withColumns({
        "source_org": found["organization"], "source_title": found["title"]}).drop("_mail", "_name", "_by_mail", "_by_name")


def clean_up(people: DataFrame, vendor: DataFrame, suspects: DataFrame, rows: DataFrame) -> DataFrame:
    """Change table of the clean-up, one row per profile in scope; applying it is a keyed update."""
    theirs = vendor.select("profile_id", F.trim("current_company").alias("_c"), F.trim("current_title").alias("_t"))
    marked = suspects.select("profile_id", F.lit(True).alias("_s"))
    joined = with_source_rows(people, rows).join(theirs, people["id"] == theirs["profile_id"], "left").drop("profile_id").join(
        marked, F.col("id") == F.col("profile_id"), "left").drop("profile_id")
    suspect = F.coalesce("_s", F.lit(False))
    shadow = lambda c: F.col(c) if c in people.columns else F.lit("")
    fill = lambda new, old: F.when((text(new) != "") & (trim_all(old) == ""), text(new))
    fixed = joined.withColumns({
        "_o": field_fix(F.col("organization"), F.col("_c"), F.col("source_org"), suspect),
        "_h": field_fix(F.col("title"), F.col("_t"), F.col("source_title"), suspect),
        "new_enriched_organization": fill(F.col("_c"), shadow("enriched_organization")),
        "new_enriched_title": fill(F.col("_t"), shadow("enriched_title"))})
    moved = lambda fix, now: F.when(F.col(f"{fix}.value") != text(now), F.col(f"{fix}.value"))
    # Reviewing, counting and applying must see the same table, so it is kept.
    return cut_lineage(fixed.select(
        "id", suspect.alias("suspect"), F.col("organization").alias("old_organization"), F.col("title").alias("old_title"),
        moved("_o", "organization").alias("new_organization"), moved("_h", "title").alias("new_title"),
        F.col("_o.reason").alias("organization_reason"), F.col("_h.reason").alias("title_reason"),
        "new_enriched_organization", "new_enriched_title"))


def clean_up_counts(changes: DataFrame) -> DataFrame:
    touched = F.col("new_organization").isNotNull() | F.col("new_title").isNotNull()
    restored = F.concat_ws(" ", "organization_reason", "title_reason").contains("restored-from-source")
    suspect = F.col("suspect")
    return changes.agg(
        F.count("*").alias("scanned"), F.count_if(suspect & touched).alias("wrong_person_fixed"),
        F.count_if(suspect & touched & restored).alias("wrong_person_restored_from_source"),
        F.count_if(suspect & touched & ~restored).alias("wrong_person_blanked"),
        F.count_if(F.col("new_enriched_organization").isNotNull() | F.col("new_enriched_title").isNotNull()).alias("shadow_field_populated"),
        F.count_if(~suspect & touched).alias("backfill_cleared_nonsuspect"), F.count_if(suspect & ~touched).alias("skipped_uncertain"),
        F.count_if(~suspect & ~touched).alias("already_clean"))


def clean_up_sample(changes: DataFrame, most: int = 25) -> DataFrame:
    """Before and after of some changed rows, for review before applying."""
    touched = F.col("new_organization").isNotNull() | F.col("new_title").isNotNull()
    return changes.where(touched).orderBy("id").limit(most).select(
        "id", "old_organization", "new_organization", "old_title", "new_title")


# --- arbiter against the plain rule --------------------------------------------------------------
def arbiter_comparison(people: DataFrame, ties: DataFrame, candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """What the arbiter said about profiles skipped for a tie.

    ``ties`` and ``candidates`` are rebuilt from the log; the top five by score are the
    ones the answer's index points into.
    """
    skipped = people.where(F.col("enrichment_status") == "skipped").select(F.col("id").alias("profile_id"))
    top = top_per_key(candidates, ["profile_id"], [F.desc("score"), F.asc("pos")], 5)
    pool = top.groupBy("profile_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda r: r["url"]).alias("pool"))
    rows = ties.join(skipped, "profile_id").join(pool, "profile_id", "left").join(answers, "profile_id", "left")
    n = F.coalesce(F.size("pool"), F.lit(0))
    picked = F.when(n >= 2, F.get("pool", F.col("winner_index")))
    outcome = (
        F.when(F.coalesce("error", F.lit(False)) & (n >= 2), "errored").when(picked.isNotNull(), "picked").otherwise("abstained")
    )
    return rows.select("profile_id", "tie_count", "tie_score", picked.alias("picked_url"), outcome.alias("outcome"))


def arbiter_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("outcome").agg(F.count("*").alias("n"))


def names_equivalent(df: DataFrame, left: str, right: str, aliases: DataFrame) -> DataFrame:
    """Adds ``equivalent``: both first names have a common alias form."""
    both = with_forms(with_forms(df, F.col(left), aliases, "_l"), F.col(right), aliases, "_r")
    return both.withColumn("equivalent", let(F.col("_l"), lambda l: F.arrays_overlap(l, F.col("_r")))).drop("_l", "_r")
