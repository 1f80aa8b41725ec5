"""Projections, queues and back-fills over stored profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.names import initials
from rollcall.functions.text import clip, first_filled, text, trim_all
from rollcall.functions.urls import clean_profile_url, is_valid_profile_url
from rollcall.operators.keyed import first_per_key, last_per_key

PENDING = "pending"
# Fixed value: the line that stands for the middle of a long log.
CUT_MARK = "... truncated ..."
# What a new run makes afresh.
DERIVED = ("linkedin_enriched", "profile_card", "field_summaries", "fetched_content")


def work_queues(people: DataFrame) -> DataFrame:
    """Profiles with the queue they wait in; the rest are left out."""
    url, named = text("linkedin_url"), text("name") != ""
    other = (text("website_url") != "") | (text("twitter_url") != "")
    if "other_links" in people.columns:
        other = other | (F.size("other_links") > 0)
    queue = F.array_compact(F.array(
        F.when((url == "") & named, "resolve"), F.when((url != "") & named & ~other, "evidence_only"),
        F.when(is_valid_profile_url(url), "enrich"), F.when((url != "") & ~is_valid_profile_url(url), "reroute")))
    return people.where(F.col("enrichment_status") == PENDING).select("id", F.explode(queue).alias("queue"))


def _bare(df: DataFrame, column: str) -> Column:
    """Nothing in a column, by its type: null or empty for maps and arrays, blank or an empty object for text."""
    if isinstance(df.schema[column].dataType, T.MapType | T.ArrayType):
        return F.coalesce(F.size(column), F.lit(0)) <= 0
    return text(column).isin("", "{}", "null")


def _emptied(df: DataFrame, column: str) -> Column:
    """The value of a column that holds nothing, in its own type: '' for text, an empty map or array, else null."""
    kind = df.schema[column].dataType
    value = F.create_map() if isinstance(kind, T.MapType) else F.array() if isinstance(kind, T.ArrayType) else \
        F.lit("") if isinstance(kind, T.StringType) else F.lit(None)
    return value.cast(kind).alias(column)


LINKS = ("twitter_url", "website_url", "resume_url")


def needs_fetch(people: DataFrame) -> DataFrame:
    """Profiles with any link, other_links included, of which nothing has been fetched yet.

    Fetched content that is missing, empty or an empty object counts as nothing, whether it
    is stored as a map or as JSON text.
    """
    linked = F.lit(False)
    for link in LINKS:
        if link in people.columns:
            linked = linked | (text(link) != "")
    if "other_links" in people.columns:
        linked = linked | (F.coalesce(F.size("other_links"), F.lit(0)) > 0)
    return people.where(linked & _bare(people, "fetched_content"))


def active(searches: DataFrame, include_archived: bool = False) -> DataFrame:
    return searches if include_archived else searches.where(F.col("archived_at").isNull())


def toggle_archived(searches: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Archive the listed searches, or bring archived ones back."""
    marked = ids.select("search_id", F.lit(True).alias("_t")).distinct()
    flipped = F.when(F.col("archived_at").isNull(), at).otherwise(None)
    return searches.join(marked, "search_id", "left").withColumn(
        "archived_at", F.when(F.col("_t"), flipped).otherwise(F.col("archived_at"))).drop("_t")


def stamp_version(people: DataFrame, tag: str = "v0-legacy") -> DataFrame:
    """Finished rows without a version get a tag."""
    old = F.col("enrichment_status").isin("enriched", "failed", "skipped") & (text("enrichment_version") == "")
    return people.withColumn("enrichment_version", F.when(old, tag).otherwise(F.col("enrichment_version")))


def fill_url_source(people: DataFrame) -> DataFrame:
    """A stored URL of unknown origin counts as resolved."""
    blank = (text("linkedin_url") != "") & (text("linkedin_url_source") == "")
    return people.withColumn("linkedin_url_source", F.when(blank, "resolved").otherwise(F.col("linkedin_url_source")))


def display_columns(people: DataFrame, vendor: DataFrame) -> DataFrame:
    """What a gallery shows: name, employer, title, place, initials."""
    theirs = vendor.select("profile_id", "full_name", "current_company", "current_title", "location")
    shadow = lambda c: F.col(c) if c in people.columns else F.lit("")
    joined = people.join(theirs, people["id"] == theirs["profile_id"], "left")
    return joined.select(
        "id", first_filled(F.col("full_name"), people["name"], F.col("email"), F.lit("Unknown")).alias("display_name"),
        trim_all(first_filled(shadow("enriched_organization"), F.col("organization"), F.col("current_company"))).alias("employer"),
        trim_all(first_filled(shadow("enriched_title"), people["title"], F.col("current_title"))).alias("job_title"),
        trim_all(F.col("location")).alias("place"), initials(people["name"]).alias("initials"))


def gallery(people: DataFrame) -> DataFrame:
    """Named profiles in two groups, ordered by name without regard to case."""
    return people.select("id", "name", (text("linkedin_url") != "").alias("found")).orderBy(
        F.desc("found"), F.lower("name"), "id")


def searchable_text(fields: DataFrame) -> DataFrame:
    """Text fields open to search: ``fields`` has profile_id, origin, field_name, body."""
    shown = fields.where(trim_all(F.col("body")) != "")
    name = F.when(F.col("origin") == "vendor", "linkedin").when(
        F.col("origin") == "fetched", F.concat(F.lit("fetched_"), F.col("field_name"))).otherwise(F.col("field_name"))
    return shown.select("profile_id", name.alias("field_name"), trim_all(F.col("body")).alias("body"))


def raw_text(card: Column, context: Column, content: Column, identity: list[Column], chars: int = 3000) -> Column:
    """Text to score: the card, else vendor text and content, else the identity values."""
    second = F.concat_ws("\n", F.nullif(text(context), F.lit("")), F.nullif(text(content), F.lit("")))
    third = F.concat_ws("\n", *[F.when(F.length(text(c)) > 2, c) for c in identity])
    return clip(first_filled(card, second, third), chars)


def route_misplaced(people: DataFrame) -> DataFrame:
    """Pending rows whose profile URL is none: the URL moves to the column it belongs to."""
    url = trim_all(F.col("linkedin_url"))
    stray = (F.col("enrichment_status") == PENDING) & ~is_valid_profile_url(url) & F.startswith(url, F.lit("http"))
    low = F.lower(url)
    resume = stray & low.rlike(r"drive\.google\.com|docs\.google\.com")
    code = stray & ~resume & F.contains(low, F.lit("github.com"))
    site = stray & ~resume & ~code
    had = F.col("resume_url") if "resume_url" in people.columns else F.lit("")
    links = F.array().cast("array<string>")
    if "other_links" in people.columns:
        links = F.coalesce("other_links", links)
    return people.withColumns({
        "resume_url": F.when(resume, first_filled(had, url)).otherwise(had),
        "other_links": F.when(code, F.array_union(links, F.array(url))).otherwise(links),
        "website_url": F.when(site, first_filled(F.col("website_url"), url)).otherwise(F.col("website_url")),
        "linkedin_url": F.when(stray, "").otherwise(F.col("linkedin_url"))})


def settle_misplaced(people: DataFrame, fetched: DataFrame) -> DataFrame:
    """:func:`route_misplaced` with what was fetched from the moved URLs, and a final status for every pending row without a profile URL.

    ``fetched``: url, source and body; of several texts of a URL the one with the smallest
    source counts. ``people`` has the map fetched_content and the list enrichment_log. With a
    text, stored or new, a row is enriched, else skipped. Only rows with a URL to move meet
    the fetched texts; the others pass without a shuffle.
    """
    texts = first_per_key(fetched.where(text("body") != ""), ["url"], ["source", "body"], ["source", "body"])
    texts = texts.select(F.col("url").alias("_url"), F.col("source").alias("_source"), F.col("body").alias("_body"))
    url = trim_all(text("linkedin_url"))
    marked = people.withColumns({
        "_open": (F.col("enrichment_status") == PENDING) & ~is_valid_profile_url(url), "_url": url,
        "fetched_content": F.coalesce("fetched_content", F.create_map().cast("map<string,string>")),
        "enrichment_log": F.coalesce("enrichment_log", F.array().cast("array<string>"))})
    stray = F.col("_open") & F.startswith("_url", F.lit("http"))
    found = route_misplaced(marked.where(stray)).join(texts, "_url", "left")
    new = F.col("_source").isNotNull()
    found = found.withColumns({
        "fetched_content": F.when(new, F.map_concat(
            F.map_filter("fetched_content", lambda k, _: k != F.col("_source")), F.create_map("_source", "_body"))).otherwise(F.col("fetched_content")),
        "enrichment_log": F.when(new, F.array_append("enrichment_log", F.concat(
            F.lit("Non-LinkedIn URL fetched as "), F.col("_source"), F.lit(": "), clip(F.col("_url"), 60)))).otherwise(F.col("enrichment_log"))})
    # A null condition is no stray row either.
    rest = route_misplaced(marked.where(~F.coalesce(stray, F.lit(False))))
    rows = rest.unionByName(found.drop("_source", "_body"))
    brought = F.size("fetched_content") > 0
    return rows.withColumns({
        "enrichment_status": F.when(~F.col("_open"), F.col("enrichment_status")).when(brought, "enriched").otherwise("skipped"),
        "enrichment_log": F.when(F.col("_open") & brought, F.array_append(
            "enrichment_log", F.lit("Enriched from non-LinkedIn URL content"))).otherwise(F.col("enrichment_log"))}).select(*people.columns)


def review_buckets(people: DataFrame) -> DataFrame:
    bucket = F.when(text("linkedin_url") == "", "missing").when(F.col("linkedin_url_source") == "user", "confirmed").otherwise("review")
    return people.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def legacy_scope(people: DataFrame, vendor: DataFrame) -> DataFrame:
    """Rows the clean-up may touch: old enriched ones, or lost ones that carry vendor values."""
    theirs = vendor.select("profile_id", F.trim("current_company").alias("_c"), F.trim("current_title").alias("_t"))
    joined = people.join(theirs, people["id"] == theirs["profile_id"], "left")
    old = (F.col("enrichment_version") == "v0-legacy") & (F.col("enrichment_status") == "enriched")
    same = lambda a, b: (text(b) != "") & (text(b) == F.trim(text(a)))
    lost = F.col("enrichment_status").isin("failed", "skipped") & (same("organization", "_c") | same("title", "_t"))
    return joined.where(old | lost).drop("profile_id", "_c", "_t")


def trim_logs(log_lines: DataFrame, edge: int = 5, longest: int = 20) -> DataFrame:
    """Logs over ``longest`` lines cut to their first and last lines around a marker.

    ``place`` counts lines per profile from both ends, found by top-k on each side, so the
    middle of a long log is dropped before the shuffle.
    """
    from rollcall.operators.keyed import top_per_key

    sizes = log_lines.groupBy("profile_id").agg(F.count("*").alias("_n"))
    joined = log_lines.join(sizes, "profile_id")
    short = joined.where(F.col("_n") <= longest).select("profile_id", "pos", "line", F.lit("kept").alias("part"))
    long = joined.where(F.col("_n") > longest)
    head = top_per_key(long, ["profile_id"], [F.asc("pos")], edge).select("profile_id", "pos", "line", F.lit("head").alias("part"))
    tail = top_per_key(long, ["profile_id"], [F.desc("pos")], edge).select("profile_id", "pos", "line", F.lit("tail").alias("part"))
    marker = head.groupBy("profile_id").agg(F.max("pos").alias("pos")).select(
        "profile_id", "pos", F.lit(CUT_MARK).alias("line"), F.lit("marker").alias("part"))
    return short.unionByName(head).unionByName(marker).unionByName(tail)


def reset_for_rerun(people: DataFrame) -> DataFrame:
    """Back to pending with what a run derives emptied, each column in its type; URLs, their sources and user data stay."""
    kept = [_emptied(people, c) if c in DERIVED else F.lit(PENDING).alias(c) if c == "enrichment_status" else F.col(c)
            for c in people.columns]
    return people.select(*kept)


def skip_pending(people: DataFrame) -> DataFrame:
    """Enrichment left out: whatever was pending counts as skipped."""
    status = F.col("enrichment_status")
    return people.withColumn("enrichment_status", F.when(status == PENDING, "skipped").otherwise(status))


def apply_corrections(people: DataFrame, corrections: DataFrame, payloads: DataFrame) -> DataFrame:
    """Hand-set profile URLs: a blank one clears and fails, another takes the landed data.

    ``corrections``: profile_id, new_url, pos (latest wins). ``payloads``: url, full_name,
    n_jobs, payload; of several for one URL the smallest in that order of columns counts.
    Both ways the photo goes; clearing empties payload and card too. The URL's source stays.
    Adds ``new_log_lines``, what the log gets.
    """
    latest = last_per_key(corrections, ["profile_id"], ["pos"], ["new_url"])
    asked = latest.select(F.col("profile_id").alias("id"), trim_all(F.col("new_url")).alias("_new"), clean_profile_url(F.col("new_url")).alias("_key"))
    landed = payloads.groupBy(clean_profile_url(F.col("url")).alias("_key")).agg(
        F.min(F.struct("url", "full_name", "n_jobs", "payload")).alias("_got"))
    joined = people.join(asked, "id", "left").join(landed, "_key", "left")
    asked_for, clear = F.col("_new").isNotNull(), F.col("_new") == ""
    given = asked_for & ~clear
    found = given & F.col("_got").isNotNull()
    lines = F.array_compact(F.array(
        F.when(clear, "LinkedIn manually cleared by user"),
        F.when(given, F.concat(F.lit("LinkedIn manually set to: "), F.col("_new"))),
        F.when(found, F.concat(F.lit("LinkedIn enriched (manual): "), F.col("_got.n_jobs").cast("string"), F.lit(" experiences")))
        .when(given, "LinkedIn set but no vendor data")))
    changed = {
        "linkedin_url": F.coalesce("_new", "linkedin_url"),
        "enrichment_status": F.when(clear, "failed").when(asked_for, "enriched").otherwise(F.col("enrichment_status")),
        "name": F.when(found, first_filled(F.col("name"), F.col("_got.full_name"))).otherwise(F.col("name")),
        "linkedin_enriched": F.when(clear, "").when(found, F.col("_got.payload")).otherwise(F.col("linkedin_enriched")),
        "profile_card": F.when(clear, "").otherwise(F.col("profile_card")),
        "photo_path": F.when(asked_for, "").otherwise(F.col("photo_path"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in people.columns], lines.alias("new_log_lines"))
