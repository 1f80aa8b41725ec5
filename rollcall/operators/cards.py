"""Short text cards of profiles, field summaries, and link requests with their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import MEDIUM_TEXT, SHORT_TEXT, TIER_PRIORITY
from rollcall.functions.html import article_text, bio_text
from rollcall.functions.text import let, text, title_case_label, trim_all
from rollcall.functions.urls import link_type, loose_url_key
from rollcall.operators.columns import field_tier
from rollcall.operators.keyed import first_per_key


def _rstrip(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+$", "")


def _cut(body: Column, chars: int) -> Column:
    return F.concat(_rstrip(F.left(body, F.lit(chars))), F.lit("..."))


def _notes(body: Column) -> Column:
    """Cut at a sentence end beyond 60% of the limit, else at the limit."""
    head = F.left(body, F.lit(MEDIUM_TEXT))
    dot = F.when(F.contains(head, F.lit(".")), MEDIUM_TEXT - F.instr(F.reverse(head), ".") + 1).otherwise(0)
    return F.when(F.length(body) <= MEDIUM_TEXT, body).when(dot - 1 > MEDIUM_TEXT * 0.6, F.left(head, dot)).otherwise(
        _cut(body, MEDIUM_TEXT))


def _sections(body: Column, per_section: int = 5) -> Column:
    """Experience and education lists cut to their first lines."""
    def step(acc: Column, line: Column) -> Column:
        header = F.trim(line).rlike("^(Experience:|Education:)")
        keep = header | (acc["n"] < per_section)
        return F.struct(
            F.when(keep, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"),
            F.when(header, 0).otherwise(acc["n"] + 1).alias("n"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    kept = F.aggregate(F.split(body, "\n"), start, step, lambda acc: trim_all(F.array_join(acc["kept"], "\n")))
    return let(kept, lambda k: F.when(F.length(k) > MEDIUM_TEXT, _cut(k, MEDIUM_TEXT)).otherwise(k))


def _first_sentence(name: Column, body: Column) -> Column:
    sentence = trim_all(F.substring_index(body, ".", 1))
    short = let(sentence, lambda s: F.when(F.length(s) > 120, _cut(s, 120)).otherwise(s))
    return F.concat(title_case_label(name), F.lit(": "), short, F.lit("."))


def summarize(name: Column, body: Column, tier: Column) -> Column:
    """Field text shortened by what kind of field it is; short text stays as it is."""
    return let(trim_all(body), lambda b: (
        F.when(F.length(b) <= SHORT_TEXT, b).when(tier.isin("first_person", "expert_assessment"), _notes(b))
        .when(tier == "linkedin", _sections(b)).when(tier == "self_reported", _first_sentence(name, b))
        .otherwise(F.when(F.length(b) > MEDIUM_TEXT, _cut(b, MEDIUM_TEXT)).otherwise(b))))


def field_summaries(fields: DataFrame) -> DataFrame:
    """Tier and summary per field: profile_id, field_name, body."""
    tiered = fields.where(trim_all(F.col("body")) != "").withColumn("tier", field_tier(F.col("field_name"), F.col("body")))
    return tiered.withColumn("summary", summarize(F.col("field_name"), F.col("body"), F.col("tier")))


def build_cards(people: DataFrame) -> DataFrame:
    """Card per profile: header, vendor summary, then fields by tier and order.

    ``people``: id, name, title, organization, vendor_text and content_fields, an array of
    (key, value) in upload order.
    """
    name, title, org = F.coalesce(F.nullif(text("name"), F.lit("")), F.lit("Unknown")), text("title"), text("organization")
    role = F.when((title != "") & (org != ""), F.concat(title, F.lit(" at "), org)).when(title != "", title).when(org != "", org)
    header = F.concat_ws(" | ", name, role)

    def part(e: Column, i: Column) -> Column:
        return let(field_tier(e["key"], e["value"]), lambda tier: shown_part(e, i, tier))

    def shown_part(e: Column, i: Column, tier: Column) -> Column:
        rank = F.coalesce(*[F.when(tier == t, p) for t, p in TIER_PRIORITY.items()], F.lit(2))
        label = title_case_label(e["key"])
        shown = let(summarize(e["key"], e["value"], tier), lambda s: F.when(
            F.startswith(F.lower(s), F.lower(label)), s).otherwise(F.concat(label, F.lit(": "), s)))
        return F.struct(rank.alias("rank"), i.alias("place"), shown.alias("shown"))

    filled = F.filter("content_fields", lambda e: trim_all(e["value"]) != "")
    ordered = F.transform(F.array_sort(F.transform(filled, part)), lambda p: F.concat(F.lit("\n"), p["shown"]))
    vendor = summarize(F.lit("linkedin"), text("vendor_text"), F.lit("linkedin"))
    linkedin = F.when(text("vendor_text") != "", F.concat(F.lit("\n"), vendor))
    return people.select("id", trim_all(F.concat_ws("\n", header, linkedin, F.array_join(ordered, "\n"))).alias("profile_card"))


# --- links to fetch and what came back --------------------------------------------------------
def link_requests(people: DataFrame) -> DataFrame:
    """Every link of a profile as a typed request for an outside fetcher."""
    def request(slot: Column | str, url: Column, kind: Column | str | None = None) -> Column:
        as_col = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(as_col(slot).alias("slot"), url.alias("url"), (link_type(url) if kind is None else as_col(kind)).alias("kind"))

    others = F.col("other_links") if "other_links" in people.columns else F.array().cast("array<string>")
    resume = F.col("resume_url") if "resume_url" in people.columns else F.lit("")
    fixed = F.array(request("twitter", text("twitter_url"), "twitter"), request("website", text("website_url"), "website"), request("resume", text(resume)))
    more = F.transform(others, lambda u, i: request(F.concat(F.lit("link_"), i.cast("string")), u))
    return people.select(F.col("id").alias("profile_id"), F.inline(F.filter(F.concat(fixed, more), lambda r: r["url"] != "")))


def fetched_text(requests: DataFrame, pages: DataFrame, shortest: int = 50) -> DataFrame:
    """Bio text of the landed page of each request; empty where nothing usable landed."""
    landed = pages.select(loose_url_key(F.col("url")).alias("_key"), bio_text(article_text(F.col("html"))).alias("_bio")).where(
        F.length("_bio") >= shortest)
    once = first_per_key(landed, ["_key"], ["_bio"], ["_bio"])
    return requests.withColumn("_key", loose_url_key(F.col("url"))).join(once, "_key", "left").withColumn(
        "body", F.coalesce("_bio", F.lit(""))).drop("_key", "_bio")


def social_bio(results: DataFrame) -> DataFrame:
    """Bio of a social profile from search results: profile_id, handle, pos, url, title, description.

    The profile page itself goes before the first page that mentions the handle.
    """
    url, handle = F.regexp_replace(F.lower(text("url")), "/+$", ""), F.lower("handle")
    own = F.endswith(url, F.concat(F.lit("/"), handle)) & url.rlike(r"x\.com|twitter\.com")
    turn = F.when(own, 0).when(F.contains(F.lower("url"), handle), 1)
    picked = first_per_key(results.withColumn("_turn", turn).where("_turn IS NOT NULL"), ["profile_id"], ["_turn", "pos"], ["title", "description"])
    title = trim_all(F.regexp_replace(trim_all(F.regexp_replace(text("title"), r"\s*/\s*X\s*$", "")), r"\s*/\s*Twitter\s*$", ""))
    about = F.when(~F.contains(F.lower(text("description")), F.lit("javascript is not available")),
                   trim_all(F.regexp_replace(text("description"), "<[^>]+>", "")))
    shown = F.concat_ws("\n", F.when(title != "", F.concat(F.lit("X/Twitter: "), title)),
                        F.when(about != "", F.concat(F.lit("Bio: "), about)))
    return picked.select("profile_id", shown.alias("body"))


def code_bio(records: DataFrame, most: int = 5) -> DataFrame:
    """Readable bio of a code-host user: profile_id, body (user JSON with a ``repos`` list)."""
    schema = ("name STRING, login STRING, bio STRING, company STRING, location STRING, repos "
              "ARRAY<STRUCT<name: STRING, description: STRING, stargazers_count: INT, language: STRING>>")
    u = F.from_json("body", schema)

    def line(r: Column) -> Column:
        about, stars, lang = text(r["description"]), F.coalesce(r["stargazers_count"], F.lit(0)), text(r["language"])
        return F.concat(
            F.lit("  "), text(r["name"]), F.when(about != "", F.concat(F.lit(" — "), F.left(about, F.lit(80)))).otherwise(""),
            F.when(stars > 0, F.concat(F.lit(" ("), stars.cast("string"), F.lit(" stars)"))).otherwise(""),
            F.when(lang != "", F.concat(F.lit(" ["), lang, F.lit("]"))).otherwise(""))

    labelled = lambda label, c: F.when(text(c) != "", F.concat(F.lit(label), c))
    rows = records.select("profile_id", u.alias("u"))
    repos = F.transform(F.slice(F.coalesce("u.repos", F.array()), 1, most), line)
    return rows.select("profile_id", F.concat_ws(
        "\n", F.concat(F.lit("GitHub: "), F.coalesce("u.name", "u.login", F.lit(""))), labelled("Bio: ", F.col("u.bio")),
        labelled("Company: ", F.col("u.company")), labelled("Location: ", F.col("u.location")),
        F.when(F.size(repos) > 0, F.concat(F.lit("Repos:\n"), F.array_join(repos, "\n")))).alias("body"))
