"""Evidence of a person's web presence: collecting, merging, judging, writing back.

An evidence row: profile_id, pos, url, source, kind, anchors (array), snippet, title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.emails import email_local, org_domain, signal_cohort
from rollcall.functions.fixed_values import (
    ANCHOR_TYPES,
    OPEN_WEB_BLOCKED_HOSTS,
    SEARCH_PRICE,
    VENDOR_PRICE,
)
from rollcall.functions.html import anchors, page_text, resolve_href, window_around
from rollcall.functions.names import name_slugs, signal_first, signal_last, signal_tokens
from rollcall.functions.text import (
    clip,
    first_filled,
    has_any,
    squeeze,
    text,
    trim_all,
)
from rollcall.functions.urls import clean_profile_url, evidence_url_key, host, is_valid_profile_url, match_slug, path
from rollcall.operators.grams import contained
from rollcall.operators.keyed import first_per_key
from rollcall.session import cut_lineage

def _empty() -> Column:
    return F.lit("")

# Order in which stages run; later ones are skipped once two URLs are strong.
STAGE_OF_SOURCE = {"org_site": 2, "openalex": 3, "github": 3, "substack": 3, "linkedin": 4, "open_web": 5}
LAST_STAGE = 5


def _anchor_list(flags: dict[str, Column]) -> Column:
    """Sorted anchors whose flag is true."""
    return F.array_compact(F.array(*[F.when(flags[a], F.lit(a)) for a in ANCHOR_TYPES if a in flags]))


def _link_kind(where: Column, otherwise: Column | str, x_host: Column) -> Column:
    return (
        F.when(F.contains(where, F.lit("linkedin.com")), "linkedin").when(F.contains(where, F.lit("twitter.com")) | x_host, "twitter")
        .when(F.contains(where, F.lit("github.com")), "github").when(F.contains(where, F.lit("substack.com")), "substack")
        .otherwise(otherwise)
    )


# --- first stage ---------------------------------------------------------------------------
def profile_signals(people: DataFrame) -> DataFrame:
    """Cohort, organisation domain, mailbox, outer names and URL slugs of every profile."""
    mail = F.col("email")
    staged = people.select(
        F.col("id").alias("profile_id"), "organization", signal_cohort(mail).alias("cohort"), org_domain(mail).alias("org_domain"),
        email_local(mail).alias("email_local"), signal_tokens(F.col("name")).alias("_tokens"))
    staged = staged.withColumns({"first": signal_first(F.col("_tokens")), "last": signal_last(F.col("_tokens"))}).drop("_tokens")
    return staged.withColumn("name_slugs", name_slugs(F.col("first"), F.col("last")))


# --- organisation pages ----------------------------------------------------------------------
def org_site_evidence(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """Links on an organisation's landed pages that name one of its people.

    Evidence is found per distinct (org_domain, first, last), not per profile. Slugs are looked
    for in the distinct paths of a domain's links, first and last names in their distinct texts,
    through an index of three-letter pieces (:mod:`grams`); texts of pages are extracted only
    where a link was found. Join the result to profiles on the three columns. ``pages``: url, html.
    """
    # Names are read back by every look-up below; their signals are worked out once. Choosing comes
    # after that: a condition would move down to the profiles and work them out again for each mention.
    who = cut_lineage(signals.select("org_domain", "first", "last").distinct()).where(
        (F.col("org_domain") != "") & (F.col("first") != "") & ((F.col("last") != "") | (F.length("first") >= 5)))
    slugs = who.select("org_domain", "first", "last", F.posexplode(name_slugs(F.col("first"), F.col("last"))).alias("turn", "slug"))

    owned = pages.select("url", "html", host(F.col("url")).alias("org_domain")).join(
        who.select("org_domain").distinct(), "org_domain", "left_semi")
    links = owned.select("org_domain", F.col("url").alias("page_url"), F.posexplode(anchors(F.col("html"))).alias("link_no", "link"))
    links = links.withColumns({"url": resolve_href(F.col("page_url"), F.col("link.href")), "link_text": F.col("link.text")}).where(
        (F.col("link.href") != "") & (host(F.col("url")) != ""))
    # Links meet names along three paths; parsed once, they are read back.
    links = cut_lineage(links.select(
        "org_domain", "page_url", "link_no", "url", "link_text", F.lower(path(F.col("url"))).alias("low_path"),
        F.lower("link_text").alias("low_text")))
    key = ["page_url", "link_no"]
    whole = ["org_domain", "first", "last"]
    placed = links.select(*key, "org_domain", "low_path", "low_text")

    in_paths = contained(slugs, links, ["org_domain"], "slug", "low_path")
    by_slug = in_paths.join(slugs, ["org_domain", "slug"]).groupBy(*whole, "low_path").agg(
        F.min_by("slug", "turn").alias("slug_hit")).join(placed, ["org_domain", "low_path"]).select(*key, *whole, "slug_hit")
    # First and last names meet per text before the links that have it come in.
    firsts = contained(who, links, ["org_domain"], "first", "low_text")
    lasts = contained(who, links, ["org_domain"], "last", "low_text")
    pairs = firsts.join(who.where("last <> ''"), ["org_domain", "first"]).join(lasts, ["org_domain", "last", "low_text"])
    singles = firsts.where(F.length("first") >= 5).join(who.where("last = ''"), ["org_domain", "first"])
    named = pairs.select(*whole, "low_text").unionByName(singles.select(*whole, "low_text"))
    by_text = named.join(placed, ["org_domain", "low_text"]).select(*key, *whole, F.lit(True).alias("in_text"))

    hits = by_slug.join(by_text, [*key, *whole], "full_outer").join(links.select(*key, "url", "link_text"), key)
    shown = pages.join(hits.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi").select(
        F.col("url").alias("page_url"), page_text(F.col("html")).alias("body"))
    hits = hits.join(shown, "page_url")
    slug_hit = F.coalesce("slug_hit", _empty())
    bio = window_around(F.col("body"), first_filled(F.col("link_text"), slug_hit))
    hits = hits.withColumns({"snippet": bio, "in_text": F.coalesce("in_text", F.lit(False)), "slug_hit": slug_hit})
    about = (F.col("snippet") != "") & (F.contains(F.lower("snippet"), F.col("first")) | (
        (F.col("last") != "") & F.contains(F.lower("snippet"), F.col("last"))) | (F.col("last") == ""))
    where = host(F.col("url"))
    kind = _link_kind(where, F.when(F.contains(where, F.col("org_domain")), "bio").otherwise("listing"),
                      (where == "x.com") | F.endswith(where, F.lit(".x.com")))
    found = hits.select(
        "org_domain", "first", "last", "page_url", "link_no", "url", evidence_url_key(F.col("url")).alias("url_key"),
        F.lit("org_site").alias("source"), kind.alias("kind"), F.col("link_text").alias("title"), "snippet",
        _anchor_list({"email_match": F.lit(True), "name_match": F.col("in_text"), "slug_match": F.col("slug_hit") != "",
                      "bio_match": about}).alias("anchors"))
    return first_per_key(found, ["org_domain", "first", "last", "url_key"], ["page_url", "link_no"],
                         ["url", "source", "kind", "title", "snippet", "anchors"])


# --- landed records of other services ---------------------------------------------------------
def _letters(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(col)), F.lit("([a-z]+)"), F.lit(1))


def _named(words: Column) -> Column:
    first, last = F.col("first"), F.col("last")
    return (first != "") & F.array_contains(words, first) & ((last == "") | F.array_contains(words, last))


def author_evidence(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Scholarly author records: name required; institution domain and works add anchors.

    ``records``: profile_id, pos, body (JSON of one author).
    """
    schema = ("id STRING, display_name STRING, works_count INT, last_known_institution "
              "STRUCT<homepage_url: STRING, ror: STRING, id: STRING, display_name: STRING>")
    rows = records.select("profile_id", "pos", F.from_json("body", schema).alias("a")).join(signals, "profile_id")
    domain = F.col("org_domain")
    root = F.regexp_extract(domain, r"([^.]+\.[^.]+|[^.]+)$", 1)
    inst = F.col("a.last_known_institution")
    linked = F.lit(False)
    for part in ("homepage_url", "ror", "id"):
        value = F.lower(text(inst[part]))
        linked = linked | F.contains(value, domain) | F.contains(value, root)
    nick = F.split_part(root, F.lit("."), F.lit(1))
    linked = (domain != "") & inst.isNotNull() & (linked | ((nick != "") & F.contains(F.lower(squeeze(inst["display_name"])), nick)))
    name, works = text(F.col("a.display_name")), F.coalesce("a.works_count", F.lit(0))
    kept = rows.where((text(F.col("a.id")) != "") & _named(_letters(name)))
    shown = F.concat(name, F.lit(" — "), text(inst["display_name"]), F.lit(" ("), works.cast("string"), F.lit(" works)"))
    return kept.select(
        "profile_id", "pos", trim_all(F.col("a.id")).alias("url"), F.lit("openalex").alias("source"), F.lit("profile").alias("kind"),
        _anchor_list({"name_match": F.lit(True), "email_match": linked, "platform_match": works >= 1}).alias("anchors"),
        F.trim(shown, F.lit(" —")).alias("snippet"), name.alias("title"))


def code_user_evidence(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Code-host users: name plus at least one more anchor."""
    schema = "html_url STRING, login STRING, name STRING, email STRING, company STRING, blog STRING, bio STRING, public_repos INT"
    rows = records.select("profile_id", "pos", F.from_json("body", schema).alias("u")).join(signals, "profile_id")
    low = lambda c: F.lower(text(F.col(f"u.{c}")))
    domain, first, last = F.col("org_domain"), F.col("first"), F.col("last")
    literal = (domain != "") & F.endswith(low("email"), F.concat(F.lit("@"), domain))
    near = (domain != "") & (F.contains(low("company"), domain) | F.contains(low("blog"), domain) | F.contains(low("email"), domain))
    bio = (low("bio") != "") & (first != "") & F.contains(low("bio"), first) & ((last == "") | F.contains(low("bio"), last))
    slug = match_slug(F.col("name_slugs"), F.col("u.login")) != ""
    repos = (F.coalesce("u.public_repos", F.lit(0)) >= 1) | (low("bio") != "")
    kept = rows.where(_named(_letters(F.col("u.name"))) & (literal | near | bio | slug))
    at = F.trim(F.concat(text(F.col("u.name")), F.lit(" @ "), text(F.col("u.company"))), F.lit(" @"))
    return kept.select(
        "profile_id", "pos", first_filled(F.col("u.html_url"), F.concat(F.lit("https://github.com/"), text(F.col("u.login")))).alias("url"),
        F.lit("github").alias("source"), F.lit("github").alias("kind"),
        _anchor_list({"name_match": F.lit(True), "slug_match": slug, "email_match": literal | near, "literal_email": literal,
                      "bio_match": bio, "platform_match": repos}).alias("anchors"),
        first_filled(F.col("u.bio"), at).alias("snippet"), first_filled(F.col("u.name"), F.col("u.login")).alias("title"))


def publication_evidence(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Newsletter publications, whatever list key the payload uses; name or slug required."""
    item = ("ARRAY<STRUCT<base_url: STRING, url: STRING, custom_domain: STRING, name: STRING, title: STRING, "
            "description: STRING, subtitle: STRING, author_name: STRING>>")
    schema = ", ".join(f"{k} {item}" for k in ("results", "publications", "hits", "items"))
    parsed = records.select("profile_id", "pos", F.from_json("body", schema).alias("b"))
    items = F.coalesce(*[F.col(f"b.{k}") for k in ("results", "publications", "hits", "items")])
    rows = parsed.select("profile_id", "pos", F.explode(items).alias("p")).join(signals, "profile_id")
    p = lambda c: F.col(f"p.{c}")
    raw = first_filled(p("base_url"), p("url"), p("custom_domain"))
    url = F.when((raw == "") | F.startswith(raw, F.lit("http")), raw).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
    title, about = first_filled(p("name"), p("title")), first_filled(p("description"), p("subtitle"))
    words, about_words = _letters(F.concat_ws(" ", title, text(p("author_name")))), _letters(about)
    slug = (url != "") & (match_slug(F.col("name_slugs"), url) != "")
    bio = (F.col("last") != "") & _named(about_words)
    kept = rows.where(_named(words) | slug)
    return kept.select(
        "profile_id", "pos", first_filled(url, F.concat(F.lit("https://substack.com/@"), text(p("author_name")))).alias("url"),
        F.lit("substack").alias("source"), F.lit("substack").alias("kind"),
        _anchor_list({"name_match": _named(words), "slug_match": slug, "bio_match": bio, "platform_match": F.lit(True)}).alias("anchors"),
        first_filled(about, title).alias("snippet"), title.alias("title"))


def resolver_evidence(resolved: DataFrame, signals: DataFrame, priors: DataFrame) -> DataFrame:
    """Resolved profile URLs as evidence, with the anchors of an organisation page that links them.

    ``resolved``: profile_id, linkedin_url, confidence. ``priors``: evidence rows.
    """
    rows = resolved.where("linkedin_url <> ''").join(signals, "profile_id").select(
        "profile_id", "confidence", "name_slugs", clean_profile_url(F.col("linkedin_url")).alias("url"))
    rows = rows.withColumn("url_key", evidence_url_key(F.col("url")))
    prior = merge_evidence(priors.where("source = 'org_site'")).select("profile_id", "url_key", F.col("anchors").alias("prior"))
    own = _anchor_list({"name_match": F.col("confidence").isin("high", "medium"), "platform_match": F.lit(True),
                        "slug_match": match_slug(F.col("name_slugs"), F.col("url")) != ""})
    joined = rows.join(prior, ["profile_id", "url_key"], "left")
    return joined.select(
        "profile_id", F.lit(0).cast("long").alias("pos"), "url", F.lit("linkedin").alias("source"), F.lit("linkedin").alias("kind"),
        F.array_sort(F.array_union(own, F.coalesce("prior", F.array().cast("array<string>")))).alias("anchors"),
        _empty().alias("snippet"), _empty().alias("title"))


def _result_flags(url: Column) -> dict[str, Column]:
    """Anchors of a search result: both names in its text, own domain or name slug in its lower-cased URL."""
    shown = F.lower(F.concat_ws(" ", text("title"), text("description")))
    return {
        "name_match": F.contains(shown, F.col("first")) & F.contains(shown, F.col("last")),
        "email_match": (F.col("org_domain") != "") & F.contains(url, F.col("org_domain")),
        "slug_match": match_slug(F.col("name_slugs"), url) != ""}


def resolver_side_evidence(results: DataFrame, signals: DataFrame, people: DataFrame) -> DataFrame:
    """Other pages that the resolver's search brought up: at least one of name, own domain and slug.

    Only people without a usable profile URL were searched for. ``results``: profile_id, pos,
    url, title, description; every result is a row of its own.
    """
    searched = people.where(~is_valid_profile_url(text("linkedin_url"))).select(F.col("id").alias("profile_id"))
    url = trim_all(F.col("url"))
    # The row-local conditions come before the joins.
    rows = results.where(url != "").withColumn("url", url).join(searched, "profile_id", "left_semi").join(signals, "profile_id")
    flags = _result_flags(F.lower("url"))
    flags["name_match"] = (F.col("first") != "") & (F.col("last") != "") & flags["name_match"]
    found = rows.select(
        "profile_id", "pos", "url", F.lit("open_web").alias("source"), F.lit("website").alias("kind"), _anchor_list(flags).alias("anchors"),
        clip(text("description"), 400).alias("snippet"), clip(text("title"), 200).alias("title"))
    return found.where(F.size("anchors") >= 1)


def open_web_evidence(results: DataFrame, signals: DataFrame) -> DataFrame:
    """Search results kept as evidence: at least two of name, own domain and slug."""
    url = trim_all(F.col("url"))
    rows = results.where((url != "") & ~has_any(F.lower(url), OPEN_WEB_BLOCKED_HOSTS)).join(
        signals.where((F.col("first") != "") & (F.col("last") != "")), "profile_id")
    low = F.lower(url)
    flags = _result_flags(low)
    found = rows.select(
        "profile_id", "pos", url.alias("url"), evidence_url_key(url).alias("url_key"), F.lit("open_web").alias("source"),
        _link_kind(low, "website", F.contains(low, F.lit("://x.com/"))).alias("kind"), _anchor_list(flags).alias("anchors"),
        clip(F.col("description"), 400).alias("snippet"), clip(F.col("title"), 200).alias("title"))
    once = first_per_key(found, ["profile_id", "url_key"], ["pos"], ["pos", "url", "source", "kind", "anchors", "snippet", "title"])
    return once.where(F.size("anchors") >= 2)


# --- merging and judging ---------------------------------------------------------------------
def merge_evidence(evidence: DataFrame) -> DataFrame:
    """One row per profile and canonical URL: anchors united, longest snippet, first title.

    Every column is an aggregate of bounded size, so a profile with very many rows is
    reduced before the shuffle.
    """
    keyed = evidence.withColumn("url_key", evidence_url_key(F.col("url")))
    has = {a: F.bool_or(F.array_contains("anchors", F.lit(a))).alias(a) for a in ANCHOR_TYPES}
    merged = keyed.groupBy("profile_id", "url_key").agg(
        F.min("pos").alias("pos"), F.min_by(F.struct("url", "source", "kind"), "pos").alias("_first"), *has.values(),
        F.max_by("snippet", F.struct(F.length(text("snippet")), -F.col("pos"))).alias("snippet"),
        F.coalesce(F.min_by("title", F.when(text("title") != "", F.col("pos"))), _empty()).alias("title"),
        F.array_sort(F.collect_set("source")).alias("sources"))
    return merged.select(
        "profile_id", "url_key", "pos", "_first.url", "_first.source", "_first.kind",
        _anchor_list({a: F.col(a) for a in ANCHOR_TYPES}).alias("anchors"), "snippet", "title", "sources")


def verdicts(people: DataFrame, merged: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """enriched / thin / hidden / failed per profile by the two-anchor rule.

    ``broken`` lists profile_id of profiles whose stages hit an infrastructure error.
    """
    return _judge(people, merged, broken).drop("n_profile_links")


def _judge(people: DataFrame, merged: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    n = F.size("anchors")
    judged = merged.groupBy("profile_id").agg(
        F.count("*").alias("n_evidence"), F.count_if(n >= 2).alias("n_strong"), F.count_if(n == 1).alias("n_weak"),
        F.size(F.collect_set(F.when(n == 1, F.col("source")))).alias("n_weak_sources"),
        F.count_if(F.array_contains("sources", F.lit("linkedin"))).alias("n_profile_links"))
    joined = people.select(F.col("id").alias("profile_id")).join(judged, "profile_id", "left").fillna(0)
    if broken is not None:
        joined = joined.join(broken.select("profile_id", F.lit(True).alias("_broken")).distinct(), "profile_id", "left")
    failed = F.coalesce("_broken", F.lit(False)) if broken is not None else F.lit(False)
    state = (
        F.when(F.col("n_strong") > 0, "enriched").when((F.col("n_weak") >= 2) & (F.col("n_weak_sources") >= 2), "enriched")
        .when(F.col("n_weak") > 0, "thin").when(failed & (F.col("n_evidence") == 0), "failed").otherwise("hidden")
    )
    return joined.withColumn("state", state).drop("_broken")


def status_of_state(state: Column) -> Column:
    return F.when(state.isin("enriched", "thin"), "enriched").when(state == "hidden", "skipped").otherwise("failed")


def state_line(state: Column) -> Column:
    """The log line that a verdict leaves; an enriched one leaves none."""
    return (
        F.when(state == "thin", "v2: thin (1 corroborating anchor)").when(state == "hidden", "v2: hidden (no public footprint)")
        .when(state == "failed", "v2: failed (infra error)").otherwise("")
    )


def run_log(written: DataFrame, judged: DataFrame) -> DataFrame:
    """The lines that a run adds to every profile's log: profile_id, part, pos and line.

    First a line per kept URL (part 0, of :func:`write_back`), then what the verdict leaves (part
    1, of :func:`verdicts`): thin, hidden and failed profiles have a line, enriched ones none.
    """
    kept = written.select("profile_id", F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), F.col("log_line").alias("line"))
    state = judged.select("profile_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), state_line(F.col("state")).alias("line"))
    return kept.unionByName(state.where("line <> ''"))


def write_back(people: DataFrame, merged: DataFrame) -> DataFrame:
    """Slot of every winning URL: free primary columns first, the rest to other_links.

    Strong evidence goes before single anchors, each in arrival order. One row per URL, so
    a profile's list never has to fit in one place. A URL that the profile's other_links
    have already gets no slot.
    """
    n = F.size("anchors")
    want = (
        F.when(F.col("kind") == "linkedin", "linkedin_url").when(F.col("kind") == "twitter", "twitter_url")
        .when(F.col("kind").isin("website", "bio", "listing"), "website_url")
        .when(F.col("kind").isin("github", "substack", "profile"), "other_links").otherwise("")
    )
    winners = merged.where(n >= 1).withColumns({"turn": F.when(n >= 2, 0).otherwise(1), "want": want})
    slots = ["linkedin_url", "twitter_url", "website_url"]
    leads = first_per_key(winners.where(F.col("want").isin(slots)), ["profile_id", "want"], ["turn", "pos"], ["url_key"])
    filled = people.select(F.col("id").alias("profile_id"), *[(text(s) != "").alias(f"_{s}") for s in slots])
    joined = winners.join(leads.withColumnRenamed("url_key", "_lead"), ["profile_id", "want"], "left").join(filled, "profile_id")
    free = F.lit(False)
    for s in slots:
        free = free | ((F.col("want") == s) & ~F.col(f"_{s}"))
    slot = (
        F.when(~F.col("want").isin(slots), F.col("want")).when(free & (F.col("url_key") == F.col("_lead")), F.col("want"))
        .when(F.col("want") == "linkedin_url", "").otherwise("other_links")
    )
    if "other_links" in people.columns:
        listed = people.select(F.col("id").alias("profile_id"), F.explode("other_links").alias("_link")).select(
            "profile_id", evidence_url_key(F.col("_link")).alias("url_key"), F.lit(True).alias("_listed")).distinct()
        joined = joined.join(listed, ["profile_id", "url_key"], "left")
        slot = F.when((slot == "other_links") & F.col("_listed"), "").otherwise(slot)
    grade = F.when(F.col("turn") == 0, "strong").otherwise("thin")
    return joined.select(
        "profile_id", "url_key", "url", "turn", "pos", slot.alias("slot"),
        F.when(text("snippet") != "", F.concat(F.lit("evidence("), grade, F.lit(","), F.col("source"), F.lit("):"), F.left("url", F.lit(80))))
        .otherwise("").alias("text_key"),
        F.concat(F.lit("v2 evidence["), F.col("source"), F.lit("/"), F.col("kind"), F.lit("]: "), F.col("url"), F.lit(" anchors="),
                 F.array_join("anchors", ",")).alias("log_line"))


# --- stages ------------------------------------------------------------------------------------
def with_stage(evidence: DataFrame) -> DataFrame:
    stage = F.lit(None).cast("int")
    for source, number in STAGE_OF_SOURCE.items():
        stage = F.when(F.col("source") == source, number).otherwise(stage)
    return evidence.withColumn("stage", stage)


def stage_cutoffs(evidence: DataFrame) -> DataFrame:
    """Last stage that ran for each profile: no stage follows two strong URLs.

    A URL turns strong at the stage that brings its second anchor, and that count only
    grows, so the cut-off is read off per-stage counts without walking the stages.
    """
    keyed = with_stage(evidence).withColumn("url_key", evidence_url_key(F.col("url")))
    arrival = [F.min(F.when(F.array_contains("anchors", F.lit(a)), F.col("stage"))).alias(a) for a in ANCHOR_TYPES]
    per_url = keyed.groupBy("profile_id", "url_key").agg(*arrival)
    second = F.get(F.array_sort(F.array_compact(F.array(*ANCHOR_TYPES))), 1)
    strong = per_url.select("profile_id", second.alias("strong_at"))
    counts = strong.groupBy("profile_id").agg(*[
        F.count_if(F.col("strong_at") <= k).alias(f"s{k}") for k in range(2, LAST_STAGE)])
    cut = F
    for k in range(2, LAST_STAGE):
        cut = cut.when(F.col(f"s{k}") >= 2, F.lit(k))
    return counts.select("profile_id", cut.otherwise(F.lit(LAST_STAGE)).alias("last_stage"))


def gate_stages(evidence: DataFrame) -> DataFrame:
    """Evidence of the stages that would have run."""
    cut = stage_cutoffs(evidence)
    return with_stage(evidence).join(cut, "profile_id").where(F.col("stage") <= F.col("last_stage")).drop("last_stage", "stage")


def staged_profiles(people: DataFrame, evidence: DataFrame, open_web_queries: int = 2) -> DataFrame:
    """State, cost and stages of every profile under the staged strategy."""
    judged = _judge(people, merge_evidence(gate_stages(evidence))).join(stage_cutoffs(evidence), "profile_id", "left")
    last = F.coalesce("last_stage", F.lit(LAST_STAGE))
    cost = (
        F.when(F.col("n_profile_links") > 0, 2 * SEARCH_PRICE + VENDOR_PRICE).otherwise(0.0)
        + F.when(last == LAST_STAGE, open_web_queries * SEARCH_PRICE).otherwise(0.0)
    )
    return judged.select(
        "profile_id", "state", status_of_state(F.col("state")).alias("enrichment_status"), "n_evidence", "n_strong",
        last.alias("last_stage"), F.round(cost, 6).alias("cost"))


def evidence_from_csv(rows: DataFrame) -> DataFrame:
    """Evidence rows whose anchors arrive as one comma-separated column."""
    parts = F.filter(F.split("anchors_csv", ","), lambda a: a != "")
    return rows.withColumn("anchors", F.array_sort(parts)).drop("anchors_csv")

