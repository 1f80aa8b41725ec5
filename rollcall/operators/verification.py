"""Rule-based check that a vendor profile belongs to the person, and what it changes.

``pairs`` has one row per (person, vendor profile): profile_id, name, organization,
linkedin_url_source, country, city, content_text from the person; url, full_name,
companies (array, current first), location, context_block from the vendor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import (
    OVERLAP_STOPWORDS,
    TRANSIENT_REASONS,
    VAGUE_ORG_STARTS,
    VAGUE_ORGS,
    VENDOR_PRICE,
    VERIFY_SUFFIX_PATTERN,
)
from rollcall.functions.text import ascii_words, first_filled, fold, let, split_words, text, trim_all
from rollcall.functions.urls import last_segment
from rollcall.operators.keyed import first_per_key

def _none() -> Column:
    return F.lit("")


def _name_words(col: Column) -> Column:
    return split_words(F.replace(col, F.lit("-"), F.lit(" ")))


def _at(words: Column, index: Column | int) -> Column:
    return F.coalesce(F.get(words, index), _none())


def name_evidence(pairs: DataFrame) -> DataFrame:
    """Adds the name step: words, overlap, strength and the hard rejects."""
    vendor = F.regexp_replace(fold(F.col("full_name"), "NFD"), VERIFY_SUFFIX_PATTERN, "")
    staged = pairs.withColumns({
        "own_name": fold(F.col("name"), "NFD"), "their_name": F.replace(trim_all(vendor), F.lit("."), _none())})
    staged = staged.withColumns({"own_words": _name_words(F.col("own_name")), "their_words": _name_words(F.col("their_name"))})
    own, their = F.col("own_words"), F.col("their_words")
    prefixed = F.array_distinct(F.filter(own, lambda a: (F.length(a) >= 4) & F.exists(
        their, lambda b: (F.length(b) >= 4) & (F.startswith(a, b) | F.startswith(b, a)))))
    shared = F.array_intersect(own, their)
    staged = staged.withColumns({
        "overlap": F.when(F.size(shared) > 0, shared).otherwise(prefixed),
        "full": F.size(own) >= 2, "compared": (F.col("own_name") != "") & (F.col("their_name") != ""),
        "own_first": _at(own, 0), "own_last": F.when(F.size(own) >= 2, _at(own, F.size(own) - 1)).otherwise("")})
    overlap, n = F.col("overlap"), F.size("overlap")
    sizes = F.transform(overlap, F.length)
    has = lambda word: F.array_contains(overlap, F.col(word))
    both = F.col("full") & has("own_first") & has("own_last")
    gone = F.col("full") & ~has("own_last") & ~F.contains("their_name", F.col("own_last"))
    reject = (
        F.when(~F.col("compared"), _none()).when(n == 0, "name_mismatch")
        .when(F.col("full") & (n == 1) & (F.array_max(sizes) < 5), "short-token-only").when(gone, "last-name-missing")
        .otherwise("")
    )
    strength = (
        F.when(~F.col("compared") | (n == 0), "none")
        .when(both & (F.length("own_first") >= 5) & (F.length("own_last") >= 5), "strong")
        .when(both | ((n >= 2) & (F.array_min(sizes) >= 4)), "normal").otherwise("weak")
    )
    return staged.withColumns({"name_reject": reject, "name_strength": strength})


def _slug_step() -> dict[str, Column]:
    slug = F.regexp_replace(last_segment(F.col("url")), r"[-_.]", "")
    compared = F.col("compared")
    in_slug = lambda word: compared & (F.length(word) >= 3) & F.contains(slug, word)
    first, last, their = F.col("own_first"), F.col("own_last"), F.col("their_words")
    their_last = F.when(F.size(their) >= 2, _at(their, F.size(their) - 1)).otherwise("")
    match = (slug != "") & in_slug(first) & in_slug(last)
    counter = (slug != "") & ~in_slug(first) & (F.length(their_last) >= 3) & F.contains(slug, their_last) & (their_last != last)
    return {"slug_match": match, "slug_counter": counter}


def _org_step() -> dict[str, Column]:
    org = F.lower(text("organization"))
    firm = F.when(F.contains(org, F.lit(" at ")), trim_all(F.regexp_extract(org, r"(?s)^.* at (.*)$", 1))).otherwise(org)
    vague = firm.isin(VAGUE_ORGS)
    for start in VAGUE_ORG_STARTS:
        vague = vague | F.startswith(firm, F.lit(start))
    companies = F.filter(F.transform("companies", lambda c: F.lower(text(c))), lambda c: c != "")
    words = F.filter(F.split(firm, r"[\s&,]+"), lambda w: F.length(w) > 3)
    same = F.exists(companies, lambda c: F.contains(c, firm) | F.contains(firm, c) | F.arrays_overlap(words, F.split(c, r"[\s&,]+")))
    checked = (org != "") & (F.size(companies) > 0) & ~vague
    return {"org_checked": checked, "org_match": checked & F.coalesce(same, F.lit(False))}


def _location_step() -> dict[str, Column]:
    city, country, place = F.lower(text("city")), F.lower(text("country")), F.lower(text("location"))
    land = trim_all(F.split_part(country, F.lit(","), F.lit(1)))
    checked = ((country != "") | (city != "")) & (place != "")
    match = ((city != "") & F.contains(place, city)) | ((F.length(land) > 3) & F.contains(place, land))
    return {"location_checked": checked, "location_match": checked & match}


def _content_step() -> dict[str, Column]:
    own, their = text("content_text"), text("context_block")
    checked = (F.length(own) > 200) & (their != "")
    stop = F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS])
    words = lambda c: F.array_except(ascii_words(c, 5), stop)
    counts = let(words(own), lambda w: F.struct(
        F.size(F.array_intersect(w, words(their))).alias("shared"), F.size(w).alias("own")))
    return {"content_checked": checked, "_words": F.when(checked, counts)}


def verify_pairs(pairs: DataFrame) -> DataFrame:
    """Decision, score, anchors and reason for every pair."""
    staged = name_evidence(pairs).withColumns({**_slug_step(), **_org_step(), **_location_step(), **_content_step()})
    shared, own_words = F.coalesce("_words.shared", F.lit(0)), F.coalesce("_words.own", F.lit(0))
    staged = staged.withColumns({
        "content_match": F.col("content_checked") & (shared >= 3),
        "content_miss": F.col("content_checked") & (shared == 0) & (own_words > 10),
        "org_miss": F.col("org_checked") & ~F.col("org_match"),
        "location_miss": F.col("location_checked") & ~F.col("location_match")})
    num = lambda c: F.col(c).cast("int")
    name_score = F.when(F.col("name_strength") == "strong", 3).when(F.col("name_strength") == "normal", 2).when(
        F.col("name_strength") == "weak", 1).otherwise(0)
    staged = staged.withColumns({
        "checks": num("org_checked") + num("location_checked") + num("content_checked"),
        "positives": num("org_match") + num("location_match") + num("content_match"),
        "penalties": num("org_miss") + num("location_miss") + num("content_miss"),
        "rule_score": name_score + 2 * num("slug_match") + 3 * num("org_match") + 2 * num("location_match")
        + 2 * num("content_match") - num("org_miss") - num("location_miss") - num("content_miss")})

    user = F.col("linkedin_url_source") == "user"
    disjoint = (F.size("own_words") > 0) & (F.size(_name_words(fold(F.col("full_name"), "NFD"))) > 0) & ~F.arrays_overlap(
        "own_words", _name_words(fold(F.col("full_name"), "NFD")))
    hard = F.col("name_reject") != ""
    s = lambda c: F.col(c).cast("string")
    alone = F.col("positives") == 0
    reason = (
        F.when(user & disjoint, "user_provided_but_names_disjoint").when(user, "user_provided_linkedin_url_trusted")
        .when(F.col("name_reject") == "name_mismatch",
              F.concat(F.lit("name mismatch ('"), F.col("own_name"), F.lit("' vs '"), F.col("their_name"), F.lit("')")))
        .when(hard, F.concat(F.lit("weak name match rejected ("), F.col("name_reject"), F.lit(")")))
        .when(F.col("rule_score") < 2, F.concat(
            F.lit("score_below_threshold (score="), s("rule_score"), F.lit(", checks="), s("checks"), F.lit(")")))
        .when((F.col("name_strength") == "weak") & alone, F.concat(
            F.lit("weak_name_no_corroboration (score="), s("rule_score"), F.lit(", penalties="), s("penalties"), F.lit(")")))
        .when((F.col("penalties") > 0) & alone, F.concat(
            F.lit("soft_penalty_no_positive (score="), s("rule_score"), F.lit(", penalties="), s("penalties"), F.lit(")")))
        .otherwise(F.concat(F.lit("accepted (name="), F.col("name_strength"), F.lit(", positives="), s("positives"),
                            F.lit(", penalties="), s("penalties"), F.lit(")")))
    )
    accept = F.startswith("reason", F.lit("accepted")) | (F.col("reason") == "user_provided_linkedin_url_trusted")
    soft = ~user & ~hard
    tag = lambda when, label: F.when(when, F.lit(label))
    positive = F.array_compact(F.array(
        tag(user, "user_provided"), F.when(soft & (F.col("name_strength") != "none"), F.concat(F.lit("name_"), F.col("name_strength"))),
        tag(soft & F.col("slug_match"), "slug_match"), tag(soft & F.col("org_match"), "org_match"),
        tag(soft & F.col("location_match"), "location_match"), tag(soft & F.col("content_match"), "content_match")))
    negative = F.array_compact(F.array(
        tag(user & disjoint, "name_zero_overlap"), tag(~user & (F.col("name_reject") == "name_mismatch"), "name_mismatch"),
        F.when(~user & hard & (F.col("name_reject") != "name_mismatch"),
               F.concat(F.lit("weak_match_"), F.replace("name_reject", F.lit("-"), F.lit("_")))),
        tag(soft & F.col("slug_counter"), "slug_matches_enriched_not_profile"), tag(soft & F.col("org_miss"), "org_mismatch"),
        tag(soft & F.col("location_miss"), "location_mismatch"), tag(soft & F.col("content_miss"), "content_mismatch")))
    score = F.when(user & disjoint, 0).when(user, 99).when(hard, 0).otherwise(F.col("rule_score"))
    decided = staged.withColumns({"reason": reason, "anchors_positive": positive, "anchors_negative": negative, "score": score})
    return decided.select(
        "profile_id", "url", F.when(user, text("full_name")).otherwise(F.col("their_name")).alias("enriched_name"), "score",
        "anchors_positive", "anchors_negative", F.when(accept, "accept").otherwise("reject").alias("decision"), "reason")


def classify_payload(status: Column, body: Column) -> Column:
    """What a landed vendor response means; ``ok`` is the only usable outcome."""
    content = trim_all(body)
    parsed = F.try_parse_json(content)
    has_error = F.coalesce(F.try_variant_get(parsed, "$.error", "string"), _none()) != ""
    return (
        F.when(status.isNull(), "transient_exhausted")
        .when(status.isin(402, 403) & F.contains(F.lower(text(body)), F.lit("credits")), "out_of_credits")
        .when(status == 429, "429_rate_limited_exhausted").when(status == 404, "404_not_found")
        .when(status.between(500, 599), "5xx_persisted")
        .when(status != 200, F.concat(F.lit("non_200:"), status.cast("string")))
        .when(content == "", "empty_body").when(parsed.isNull(), "json_parse_error")
        .when(has_error, "api_error_field").otherwise("ok")
    )


def is_transient(outcome: Column) -> Column:
    return outcome.isin(TRANSIENT_REASONS) | F.startswith(outcome, F.lit("non_200:5"))


_YEAR = "STRUCT<year: STRING>"
PAYLOAD_SCHEMA = (
    "full_name STRING, headline STRING, occupation STRING, location_str STRING, city STRING, summary STRING, "
    f"profile_pic_url STRING, experiences ARRAY<STRUCT<company: STRING, title: STRING, description: STRING, starts_at: {_YEAR}, ends_at: {_YEAR}>>, "
    f"education ARRAY<STRUCT<school: STRING, degree_name: STRING, field_of_study: STRING, starts_at: {_YEAR}, ends_at: {_YEAR}>>")


def parse_payload(body: Column, jobs: int = 10) -> Column:
    """Vendor response as a struct with experience, education and a searchable text block."""
    raw = F.from_json(body, PAYLOAD_SCHEMA)
    empty = lambda c: F.coalesce(c, _none())

    def years(e: Column, either: bool) -> Column:
        start, end = empty(e["starts_at"]["year"]), empty(e["ends_at"]["year"])
        shown = (start != "") | (end != "") if either else start != ""
        return F.when(shown, F.concat(start, F.lit("–"), end)).otherwise("")

    known = lambda name: F.filter(F.coalesce(raw[name], F.array()), lambda e: e.isNotNull())
    experience = F.transform(known("experiences"), lambda e: F.struct(
        empty(e["company"]).alias("company"), empty(e["title"]).alias("title"), years(e, False).alias("years"),
        empty(e["description"]).alias("description")))
    education = F.transform(known("education"), lambda e: F.struct(
        empty(e["school"]).alias("school"), empty(e["degree_name"]).alias("degree"),
        empty(e["field_of_study"]).alias("field_of_study"), years(e, True).alias("years")))
    span = lambda e: F.when(e["years"] != "", F.concat(F.lit(" ("), e["years"], F.lit(")"))).otherwise("")
    job_lines = F.transform(F.slice(experience, 1, jobs), lambda e: F.concat(
        F.lit("  "), e["title"], F.lit(" at "), e["company"], span(e)))
    school_lines = F.transform(education, lambda e: F.concat(
        F.lit("  "), e["degree"], F.lit(" "), e["field_of_study"], F.lit(" — "), e["school"], span(e)))
    headline = first_filled(raw["headline"], raw["occupation"])
    labelled = lambda label, c: F.when(c != "", F.array(F.concat(F.lit(label), c))).otherwise(F.array().cast("array<string>"))
    section = lambda label, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(label)), lines)).otherwise(
        F.array().cast("array<string>"))
    block = F.array_join(F.concat(
        F.array(empty(raw["full_name"])), labelled("Headline: ", headline), labelled("About: ", empty(raw["summary"])),
        section("Experience:", job_lines), section("Education:", school_lines)), "\n")
    return F.struct(
        empty(raw["full_name"]).alias("full_name"), headline.alias("headline"),
        empty(F.get(experience, 0)["company"]).alias("current_company"), empty(F.get(experience, 0)["title"]).alias("current_title"),
        first_filled(raw["location_str"], raw["city"]).alias("location"), empty(raw["summary"]).alias("summary"),
        experience.alias("experience"), education.alias("education"),
        empty(raw["profile_pic_url"]).alias("profile_pic_url"), block.alias("context_block"))


def settle_candidates(tries: DataFrame, call_price: float = VENDOR_PRICE, transient_fails: bool = False) -> DataFrame:
    """Outcome per profile of trying its candidate URLs in turn.

    ``tries``: profile_id, turn, url, outcome, verified, linkedin_url_source. The first
    verified URL wins; only transient failures leave the profile pending, unless
    ``transient_fails`` asks for the batch rule that fails them all the same.
    """
    good = (F.col("outcome") == "ok") & F.col("verified")
    broke = F.col("outcome") == "out_of_credits"
    turns = tries.groupBy("profile_id").agg(
        F.min(F.when(good | broke, F.col("turn"))).alias("stop"), F.count("*").alias("n_urls"),
        F.count_if(is_transient(F.col("outcome"))).alias("n_transient"),
        F.min_by(F.struct("url", good.alias("won")), F.when(good | broke, F.col("turn"))).alias("last"),
        F.min_by("linkedin_url_source", "turn").alias("source"))
    # The number of paid calls depends on where each profile stopped.
    stops = turns.select("profile_id", "stop")
    paid = tries.join(stops, "profile_id").where(~broke & (F.col("stop").isNull() | (F.col("turn") <= F.col("stop"))))
    calls = paid.groupBy("profile_id").agg(F.count("*").alias("calls"))
    won = F.coalesce(F.col("last.won"), F.lit(False))
    out = F.col("stop").isNotNull() & ~won
    retry = ~won & ~out & (F.col("n_transient") == F.col("n_urls"))
    status = F.when(won, "enriched").when(retry & F.lit(not transient_fails), "pending").otherwise("failed")
    kept_url = F.when(won, F.col("last.url")).when(F.col("source") == "user", None).otherwise(F.lit(""))
    return turns.join(calls, "profile_id", "left").select(
        "profile_id", status.alias("enrichment_status"), kept_url.alias("new_linkedin_url"),
        F.coalesce("calls", F.lit(0)).alias("calls"), F.round(F.coalesce("calls", F.lit(0)) * call_price, 6).alias("cost"),
        F.when(won, "").when(out, "Out of API credits").when(retry, "transient").otherwise("verification failed").alias("error"))


def backfill(people: DataFrame, vendor: DataFrame) -> DataFrame:
    """Vendor values into shadow columns; the user's own columns only where empty."""
    theirs = vendor.select("profile_id", *[F.col(c).alias(f"v_{c}") for c in ("full_name", "current_company", "current_title")])
    joined = people.join(theirs, people["id"] == theirs["profile_id"], "left").drop("profile_id")
    old = lambda c: F.col(c) if c in people.columns else _none()
    return joined.withColumns({
        "enriched_organization": first_filled(F.col("v_current_company"), old("enriched_organization")),
        "enriched_title": first_filled(F.col("v_current_title"), old("enriched_title")),
        "name": first_filled(F.col("name"), F.col("v_full_name")),
        "organization": first_filled(F.col("organization"), F.col("v_current_company")),
        "title": first_filled(F.col("title"), F.col("v_current_title")),
    }).drop("v_full_name", "v_current_company", "v_current_title")


def latest_payloads(payloads: DataFrame) -> DataFrame:
    """One landed response per URL, the latest call."""
    return first_per_key(payloads.withColumn("_age", -F.col("call_id")), ["url"], ["_age"], ["call_id", "status", "body"])
