"""From landed search results to a chosen profile URL per person.

Search requests and landed results are tables; nothing here calls out. ``pos`` is the
arrival order of a row within its profile.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.emails import base_domain, company_stem, signal_domain
from rollcall.functions.fixed_values import (
    CAPTURE_BLOCKED,
    DISTINGUISHING_SIGNALS,
    GENERIC_MAILBOXES,
    KEYWORD_STOPWORDS,
    PERSONAL_DOMAINS,
    TITLE_BROKER_HOSTS,
    TITLE_BROKER_WORDS,
    UNGRADED_DOMAINS,
)
from rollcall.functions.text import (
    ascii_words,
    clip,
    first_filled,
    has_any,
    split_words,
    text,
    trim_all,
)
from rollcall.functions.urls import (
    evidence_url_key,
    first_profile_url_in,
    host,
    is_followable,
    is_personal_profile_url,
    last_segment,
    loose_url_key,
    profile_urls_in,
)
from rollcall.operators.keyed import first_per_key, top_per_key
from rollcall.session import cut_lineage

def _empty() -> Column:
    return F.lit("")

def _no_words() -> Column:
    return F.array().cast("array<string>")


def _word_list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


# --- context -----------------------------------------------------------------------------
def keywords(fields: DataFrame, most: int = 6) -> DataFrame:
    """Telling words and word pairs per profile: profile_id, content_keywords.

    ``fields``: profile_id, field_name, body, a row per field. Per field the ten commonest pairs
    give up to three that are not all stopwords, the twenty commonest long words up to three
    more. Terms are counted inside their row, by a Python counter: a text is moved once, and of
    its words only the chosen few.
    """
    # Texts are dealt out by field, so neither a few large files nor a profile with many fields makes a long task.
    dealt = fields.where(F.length("body") > 20).select("profile_id", "field_name", "body").repartition("profile_id", "field_name")
    rows = dealt.select("profile_id", "field_name", F.array_join(ascii_words(F.col("body"), 3), " ").alias("words"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    best = rows.mapInArrow(_telling_rows, f"profile_id {kinds['profile_id']}, field_name {kinds['field_name']}, kind int, place int, term string")
    ordered = best.groupBy("profile_id").agg(
        F.sort_array(F.collect_list(F.struct("kind", "place", "field_name", "term"))).alias("ranked"))
    distinct = F.array_distinct(F.transform("ranked", lambda r: r["term"]))
    return ordered.select("profile_id", F.slice(distinct, 1, most).alias("content_keywords"))


def _telling(words: list[str]) -> list[tuple[int, int, str]]:
    """Kind (0 pair, 1 long word), place and term of the commonest telling terms; the earlier of equally common ones first."""
    stop, out = set(KEYWORD_STOPWORDS), []
    for kind, (terms, top) in enumerate(((map(" ".join, zip(words, words[1:])), 10), ([w for w in words if len(w) >= 5], 20))):
        ranked = [term for term, _ in Counter(terms).most_common(top)]
        out.extend((kind, place, term) for place, term in enumerate([t for t in ranked if not stop.issuperset(t.split(" "))][:3]))
    return out


def _telling_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, *t) for i, words in enumerate(batch.column(2).to_pylist()) if words for t in _telling(words.split(" "))]
        at, kinds, places, terms = (list(c) for c in zip(*found)) if found else ([], [], [], [])
        picked = batch.select(["profile_id", "field_name"]).take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*picked.columns, pa.array(kinds, pa.int32()), pa.array(places, pa.int32()), pa.array(terms, pa.string())],
            ["profile_id", "field_name", "kind", "place", "term"])


def extract_context(people: DataFrame, keyword_table: DataFrame | None = None) -> DataFrame:
    """Search context of every named profile.

    ``people`` may carry ``metadata``, an ordered array of (key, value): the first title
    and organisation found there fill gaps, the last country and city count.
    """
    entries = F.col("metadata") if "metadata" in people.columns else F.array().cast(
        "array<struct<key:string,value:string>>")

    def mined(pattern: str, last: bool = False) -> Column:
        hits = F.filter("_real", lambda e: F.lower(e["key"]).rlike(pattern))
        return F.coalesce(trim_all(F.get(hits, F.size(hits) - 1 if last else F.lit(0))["value"]), _empty())

    # Columns of their own, as each is read several times below.
    staged = people.where(trim_all(F.col("name")) != "").withColumns({
        "_words": split_words(F.col("name")),
        "_real": F.filter(entries, lambda e: trim_all(e["value"]) != ""),
        "_domain": F.when(F.contains("email", F.lit("@")), F.regexp_extract("email", "([^@]*)$", 1)).otherwise("")})
    words, domain = F.col("_words"), F.col("_domain")
    owned = (domain != "") & ~domain.isin(PERSONAL_DOMAINS)
    context = staged.select(
        F.col("id").alias("profile_id"), "name", text("email").alias("email"),
        F.get(words, 0).alias("first"), F.when(F.size(words) > 1, F.get(words, F.size(words) - 1)).otherwise("").alias("last"),
        first_filled(F.col("organization"), mined("org|company")).alias("org"),
        first_filled(F.col("title"), mined("title|role")).alias("title"),
        mined("country|region", last=True).alias("country"), mined("city|nearest", last=True).alias("city"),
        F.when(owned, F.split_part(domain, F.lit("."), F.lit(1))).otherwise("").alias("email_domain"),
        F.when(owned, company_stem(domain)).otherwise("").alias("email_company"))
    if keyword_table is None:
        return context.withColumn("content_keywords", _no_words())
    return context.join(keyword_table, "profile_id", "left").withColumn(
        "content_keywords", F.coalesce("content_keywords", _no_words()))


# --- requests ------------------------------------------------------------------------------
def search_requests(context: DataFrame) -> DataFrame:
    """Labelled search queries per profile: profile_id, step, label, query, fallback.

    A query text occurs once per profile; ``fallback`` marks the one to run only when the
    others found nobody.
    """
    first, last, org, mail = F.col("first"), F.col("last"), F.col("org"), F.col("email")
    who = F.concat(F.lit('"'), first, F.lit(" "), last, F.lit('"'))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    on_site = lambda middle: F.concat_ws(" ", who, middle, F.lit("site:linkedin.com/in"))
    local = F.split_part(mail, F.lit("@"), F.lit(1))
    # Profiles are dealt out before the requests are written, however few files they come from.
    dealt = context.repartition("profile_id").withColumns({"_org_words": split_words(org), "_domain": signal_domain(mail)})
    org_words, domain = F.col("_org_words"), F.col("_domain")
    simple = F.coalesce(F.get(org_words, 0), _empty())
    words, place = F.col("content_keywords"), first_filled(F.col("city"), F.col("country"))
    both = (first != "") & (last != "")
    broad_key = (
        F.when(org != "", quoted(F.when(F.size(org_words) > 3, simple).otherwise(org)))
        .when(F.size(words) > 0, F.get(words, 0)).otherwise(quoted(F.col("email_domain")))
    )
    broad_label = F.when(org != "", "name+org-broad").when(F.size(words) > 0, "name+kw-broad").otherwise("name+domain-broad")

    def request(step: int, when: Column, label: Column | str, query: Column, fallback: bool = False) -> Column:
        name = F.lit(label) if isinstance(label, str) else label
        return F.when(when, F.struct(F.lit(step).alias("step"), name.alias("label"), query.alias("query"), F.lit(fallback).alias("fallback")))

    plan = F.array(
        request(1, mail != "", "email-exact", quoted(mail)),
        request(2, mail != "", "email-username", F.concat(quoted(local), F.lit(" linkedin OR researchgate"))),
        request(3, org != "", "name+org", on_site(quoted(org))),
        request(4, (F.length(simple) > 3) & (F.lower(simple) != F.lower(org)), "name+org-simple", on_site(quoted(simple))),
        request(5, F.size(words) > 0, "name+keywords", on_site(F.array_join(F.slice(words, 1, 3), " "))),
        request(6, F.col("title") != "", "name+title", on_site(quoted(F.col("title")))),
        request(7, place != "", "name+location", on_site(place)),
        request(8, F.col("email_company") != "", "name+email-domain", on_site(quoted(F.col("email_company")))),
        request(9, F.col("email_domain") != "", "name+email-domain", on_site(quoted(F.col("email_domain")))),
        request(10, (F.col("email_domain") != "") & both & ~domain.isin(PERSONAL_DOMAINS), "org-website",
                F.concat(F.lit("site:"), domain, F.lit(" "), who)),
        request(11, (org != "") | (F.size(words) > 0) | (F.col("email_domain") != ""), broad_label,
                F.concat_ws(" ", who, broad_key, F.lit("linkedin"))),
        request(12, both, "broad", F.concat(who, F.lit(" linkedin")), fallback=True),
        request(13, (mail != "") & both & ~F.lower(local).isin(GENERIC_MAILBOXES), "slug-email",
                F.concat(F.lit("site:linkedin.com/in/"), F.lower(local))),
    )
    # The plan and its texts are columns, so a lambda reads them and doesn't work them out per request.
    planned = dealt.select("profile_id", plan.alias("plan")).select(
        "profile_id", "plan", F.transform("plan", lambda r: r["query"]).alias("texts"))
    once = F.filter("plan", lambda r, i: F.array_position("texts", r["query"]) == i + 1)
    return planned.select("profile_id", F.inline(once))


# --- harvest ---------------------------------------------------------------------------------
_LABEL_ORDER = [
    "email-exact", "email-username", "name+org", "name+org-simple", "name+keywords", "name+title", "name+location",
    "name+email-domain", "org-website", "name+org-broad", "name+kw-broad", "name+domain-broad", "broad", "slug-email",
]
_FOLLOWED = ["email-exact", "org-website", "name+org-broad", "name+kw-broad", "name+domain-broad"]


def harvest_candidates(results: DataFrame, pages: DataFrame, people: DataFrame) -> DataFrame:
    """Profile URLs from results, their snippets and the landed pages they point to.

    ``results``: profile_id, pos, label, url, title, description. ``pages``: url, html.
    One row per profile and URL, the first by label and arrival; evidence_type is ``exact``
    where the literal address led to it.
    """
    domains = people.select(F.col("id").alias("profile_id"), signal_domain(F.col("email")).alias("_domain"))
    order = F.array_position(_word_list(_LABEL_ORDER), F.col("label"))
    rows = results.withColumns({
        "_label": order, "_profile": is_personal_profile_url(F.col("url")), "_in_text": first_profile_url_in(F.col("description"))})
    exact = F.col("label") == "email-exact"
    from_text, none = F.col("_in_text") != "", F.lit(None).cast("string")
    evidence = F.when(exact, "exact").otherwise("")

    def found(when: Column, turn: int, url: Column, title: Column, body: Column, proof: Column) -> Column:
        return F.when(when, F.struct(F.lit(turn).alias("turn"), url.alias("url"), title.alias("title"),
                                     body.alias("description"), proof.alias("evidence_type")))

    followed = F.col("label").isin(_FOLLOWED) & ~F.col("_profile") & ~F.contains(F.lower("url"), F.lit("linkedin.com"))
    direct = rows.select("profile_id", "pos", "_label", F.inline(F.array_compact(F.array(
        found(F.col("_profile") & F.col("label").isin("email-exact", "email-username") & from_text, 0, F.col("_in_text"),
              F.col("title"), F.col("description"), evidence),
        found(F.col("_profile") & (F.col("label") != "org-website"), 1, F.col("url"), F.col("title"), F.col("description"), evidence),
        found(followed & from_text, 2, F.col("_in_text"), F.col("title"), F.col("description"), F.lit("exact"))))))
    to_follow = rows.where(followed & ~from_text).join(domains, "profile_id").where(
        is_followable(F.col("url"), F.col("_domain")))
    on_pages = (
        pages.select(F.col("url").alias("_page"), profile_urls_in(F.col("html")).alias("_links"))
        .where(F.size("_links") > 0)
    )
    via_pages = to_follow.join(on_pages, F.col("url") == F.col("_page")).select(
        "profile_id", "pos", "_label", F.lit(3).alias("turn"), F.explode("_links").alias("_link"),
        F.concat(F.lit("via "), host(F.col("url"))).alias("via"), "title")
    followed_rows = via_pages.select(
        "profile_id", "pos", "_label", "turn", F.col("_link").alias("url"), F.col("via").alias("title"),
        F.col("title").alias("description"), F.lit("exact").alias("evidence_type"))
    every = direct.unionByName(followed_rows).withColumn("url_key", loose_url_key(F.col("url")))
    return first_per_key(every, ["profile_id", "url_key"], ["_label", "turn", "pos", "url"],
                         ["pos", "url", "title", "description", "evidence_type"])


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """First candidate per profile and URL, ignoring case and the closing slash."""
    keyed = candidates.withColumn("url_key", loose_url_key(F.col("url")))
    return first_per_key(keyed, ["profile_id", "url_key"], ["pos"], candidates.columns[1:]).drop("url_key")


def needs_second_source(first: DataFrame, second: DataFrame, enough: int = 3) -> DataFrame:
    """Results of one source, topped up from another where the first gave too few.

    Both carry query, rank, url. Rows of the second source repeat no URL of the first.
    """
    counts = first.groupBy("query").agg(F.count("*").alias("_n"))
    seen = first.select("query", "url").distinct()
    extra = second.join(counts, "query", "left").where(F.coalesce("_n", F.lit(0)) < enough).drop("_n")
    extra = extra.join(seen, ["query", "url"], "left_anti")
    return first.withColumn("engine", F.lit(1)).unionByName(extra.withColumn("engine", F.lit(2)))


def verified_companies(results: DataFrame) -> DataFrame:
    """Company named in a broker page's title for the literal address; the last one counts."""
    part = trim_all(F.split_part("title", F.lit(" | "), F.lit(2)))
    for word in TITLE_BROKER_WORDS:
        part = F.trim(F.replace(part, F.lit(word), _empty()), F.lit(" |,-."))
    broker = (F.col("label") == "email-exact") & has_any(F.lower("url"), TITLE_BROKER_HOSTS) & F.contains("title", F.lit(" | "))
    named = results.where(broker).select("profile_id", "pos", part.alias("company")).where(F.length("company") > 2)
    return named.groupBy("profile_id").agg(F.max_by("company", "pos").alias("verified_company"))


# --- scoring -----------------------------------------------------------------------------------
def score_candidates(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """Score and ordered reasons for every candidate of a profile with context.

    ``context`` may carry verified_company. Adds score, reasons and n_signals, the number
    of reasons that tell people apart, and min_score, what the best one has to reach.
    """
    if "verified_company" not in context.columns:
        context = context.withColumn("verified_company", _empty())
    plain = context.select(
        "profile_id", _min_score().alias("min_score"), F.lower("first").alias("c_first"), F.lower("last").alias("c_last"), F.lower("org").alias("c_org"),
        F.lower("title").alias("c_title"), F.lower("city").alias("c_city"), F.lower("country").alias("c_country"),
        F.lower("email_domain").alias("c_domain"), F.lower(text("verified_company")).alias("c_company"),
        F.col("content_keywords").alias("c_words"), F.lower("email").alias("c_email"))
    # Scoring is the dear part: it stands behind the exchange of a merge join, where hot profiles
    # are split, and not in the tasks that read the candidates.
    joined = candidates.join(plain.hint("merge"), "profile_id")
    title, shown = F.lower(text("title")), F.concat_ws(" ", F.lower(text("title")), F.lower(text("description")))
    first, last, org = F.col("c_first"), F.col("c_last"), F.col("c_org")
    said = lambda c: (c != "") & F.contains(F.col("_shown"), c)
    pieces = lambda c, longer: F.filter(F.split(c, r"[\s&,]+"), lambda w: F.length(w) > longer)
    joined = joined.withColumns({"_title": title, "_shown": shown, "_slug": last_segment(F.col("url"))})
    shown_words = lambda words: F.size(F.filter(words, lambda w: F.contains(F.col("_shown"), w)))

    company, firm_words = F.col("c_company"), pieces(F.col("c_company"), 2)
    org_words, hit_words = pieces(org, 3), shown_words(F.col("c_words"))
    verified = said(company) | ((F.size(firm_words) > 0) & (shown_words(firm_words) == F.size(firm_words)))
    most_words = (F.size(org_words) > 0) & (shown_words(org_words) >= F.size(org_words) * 0.6)
    title_part = F.exists(F.filter(F.split("c_title", r"\s+"), lambda w: F.length(w) > 4), lambda w: F.contains(F.col("_shown"), w))

    slug = F.col("_slug")
    bare = F.regexp_replace(slug, "[-_]", "")
    local = F.regexp_replace(F.split_part("c_email", F.lit("@"), F.lit(1)), "[.-]", "")
    parts = F.split(slug, "[-_]")
    both = F.filter(F.array(first, last), lambda p: p != "")
    exact_hits = F.size(F.filter(both, lambda p: F.array_contains(parts, p)))
    loose_hits = F.size(F.filter(both, lambda p: (F.length(p) >= 4) & F.contains(bare, p)))
    some = F.when(exact_hits > 0, exact_hits).otherwise(loose_hits)
    f1, l1 = F.left(first, F.lit(1)), F.left(last, F.lit(1))
    initialed = (first != "") & (last != "") & (F.contains(bare, F.concat(first, l1)) | F.contains(bare, F.concat(f1, last)))
    joined = joined.withColumn("_hits", F.when((some <= 1) & initialed, 2).otherwise(some))
    hits = F.col("_hits")
    lost = (F.length(last) >= 4) & ~F.contains(bare, last) & ~F.contains(slug, F.concat(f1, l1))

    def point(when: Column, score: Column | int, label: Column | str) -> Column:
        value = F.lit(score) if isinstance(score, int) else score
        name = F.lit(label) if isinstance(label, str) else label
        return F.when(when, F.struct(value.alias("score"), name.alias("reason")))

    s = lambda c: c.cast("string")
    # Read twice below and so a column of its own; inside a lambda's argument it would be interpreted, not compiled.
    points = F.array(
        point(F.col("evidence_type") == "exact", 20, "email-evidence(+20)"),
        point(F.col("evidence_type") == "proximity", 5, "email-proximity(+5)"),
        point((first != "") & F.contains("_title", first), 2, "first-in-title(+2)"),
        point((last != "") & F.contains("_title", last), 3, "last-in-title(+3)"),
        F.coalesce(point((company != "") & verified, 10, "email-verified-org(+10)"),
                   point(company != "", -3, "no-verified-org(-3)"),
                   point(said(org), 6, "org-exact(+6)"), point((org != "") & most_words, 4, "org-words(+4)")),
        F.coalesce(point(said(F.col("c_title")), 4, "title-exact(+4)"),
                   point((F.col("c_title") != "") & title_part, 2, "title-partial(+2)")),
        F.coalesce(point(said(F.col("c_city")), 2, "loc-city(+2)"), point(said(F.col("c_country")), 2, "loc-country(+2)")),
        F.coalesce(point(hit_words >= 2, 3, F.concat(F.lit("keywords("), s(hit_words), F.lit(")(+3)"))),
                   point(hit_words == 1, 1, "keywords(1)(+1)")),
        point(said(F.col("c_domain")), 3, "email-domain(+3)"),
        point((F.col("c_email") != "") & (bare == local), 8, "slug=email(+8)"),
        point(hits > 0, hits * 2, F.concat(F.lit("slug-name("), s(hits), F.lit(")(+"), s(hits * 2), F.lit(")"))),
        point(lost, -1, "slug-no-last(-1)"))
    scored = joined.withColumn("_points", points)
    scored = scored.select(
        *candidates.columns, "min_score",
        F.aggregate("_points", F.lit(0), lambda a, p: a + F.coalesce(p["score"], F.lit(0))).alias("score"),
        F.transform(F.filter("_points", lambda p: p.isNotNull()), lambda p: p["reason"]).alias("reasons"))
    telling = F.filter("reasons", lambda r: F.split_part(r, F.lit("("), F.lit(1)).isin(DISTINGUISHING_SIGNALS))
    return scored.select(
        *candidates.columns, "score", "reasons", F.size(telling).alias("n_signals"), "min_score")


def _min_score() -> Column:
    """Score a best candidate has to reach, higher with more context."""
    rich = sum((F.when(F.col(c) != "", 1).otherwise(0) for c in ("org", "title", "city", "country", "email_domain")), F.lit(0))
    rich = rich + F.when(F.size("content_keywords") > 0, 1).otherwise(0)
    return F.lit(3) + F.least(rich, F.lit(3))


def resolve(scored: DataFrame, arbiter: DataFrame | None = None) -> DataFrame:
    """Chosen URL per profile, or why none was chosen.

    Without an arbiter ties are settled by distinguishing signals, then accepted up to
    three wide. ``arbiter`` (profile_id, winner_index) is consulted where scores are near
    tied or just at the threshold; profiles it has no answer for keep the plain rule.
    """
    scored = cut_lineage(scored.select("profile_id", "pos", "url", "score", "reasons", "n_signals", "min_score"))
    best = scored.groupBy("profile_id").agg(F.max("score").alias("best_score"), F.max("min_score").alias("min_score"))
    by_rank = [F.desc("score"), F.asc("pos")]
    row = F.struct("url", "score", "reasons", "n_signals")
    top = top_per_key(scored, ["profile_id"], by_rank, 5)
    at = lambda r: F.max(F.when(F.col("rank") == r, row))
    heads = top.groupBy("profile_id").agg(
        *[at(r).alias(f"r{r}") for r in (1, 2)],
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", "score", "reasons"))), lambda x: x).alias("pool"))
    near = scored.drop("min_score").join(best, "profile_id").where(F.col("score") >= F.col("best_score") - 1)
    widths = near.groupBy("profile_id").agg(
        F.count("*").alias("n_near"), F.count_if(F.col("score") == F.col("best_score")).alias("n_tied"))
    signals = (
        near.where(F.col("score") == F.col("best_score")).groupBy("profile_id", "n_signals")
        .agg(F.count("*").alias("n"), F.min_by(F.struct("url", "score", "reasons"), "pos").alias("lead"))
        .groupBy("profile_id").agg(F.max_by(F.struct("n", "lead"), "n_signals").alias("strongest"))
    )
    state = heads.join(widths, "profile_id").join(signals, "profile_id").join(
        best.select("profile_id", "min_score"), "profile_id")
    if arbiter is None:
        state = state.withColumns({"winner_index": F.lit(None).cast("int"), "asked": F.lit(False)})
    else:
        answers = arbiter.select("profile_id", "winner_index", F.lit(True).alias("asked"))
        state = state.join(answers, "profile_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    score = F.col("r1.score")
    weak = score < F.col("min_score")
    unclear = (F.col("n_near") >= 2) | (score == F.col("min_score"))
    asked = F.col("asked") & unclear & ~weak
    pool_size = F.least(F.lit(5), F.when(F.col("n_near") >= 2, F.col("n_near")).otherwise(2), F.size("pool")).cast("int")
    answered = asked & F.coalesce(F.col("winner_index").between(F.lit(0), pool_size - 1), F.lit(False))
    tied = F.col("n_tied") > 1
    lone_signal = (F.col("r1.n_signals") > 0) & (F.col("r2.n_signals") == 0)
    stronger = tied & ~lone_signal & (F.col("strongest.n") == 1)
    lead = F.struct(F.col("r1.url").alias("url"), F.col("r1.score").alias("score"), F.col("r1.reasons").alias("reasons"))
    picked = F.get("pool", F.col("winner_index"))
    chosen = (
        F.when(answered, F.struct(picked["url"].alias("url"), picked["score"].alias("score"), picked["reasons"].alias("reasons")))
        .when(~asked & stronger, F.col("strongest.lead")).otherwise(lead)
    )
    outcome = (
        F.when(weak, "too_weak").when(asked & ~answered, "arbiter_abstained").when(answered, "arbiter_selected")
        .when(tied & ~lone_signal & ~stronger & (F.col("n_tied") > 3), "ambiguous").otherwise("selected")
    )
    final = state.withColumns({"outcome": outcome, "chosen": chosen})
    done = F.col("outcome").isin("selected", "arbiter_selected")
    value = F.col("chosen.score")
    band = F.when(value >= 12, "high").when(value >= 7, "medium").otherwise("low")
    links = F.transform("pool", lambda p: p["url"])
    tied_links = F.slice(links, F.lit(1), F.least(F.lit(4), F.col("n_tied")).cast("int"))
    return final.select(
        "profile_id", "outcome", F.when(done, F.col("chosen.url")).otherwise("").alias("linkedin_url"),
        F.when(done, band).otherwise("none").alias("confidence"), score.alias("best_score"), "min_score", "n_tied", "n_near",
        F.when(done, F.concat(F.lit("score="), value.cast("string"), F.lit(" ("), F.array_join("chosen.reasons", ", "), F.lit(")")))
        .otherwise("").alias("method"),
        F.when(done, F.slice(links, 2, 3)).when(F.col("outcome") == "too_weak", _no_words()).otherwise(tied_links).alias("alternatives"))


def arbiter_decisions(resolved: DataFrame, answers: DataFrame) -> DataFrame:
    """Decision record of every profile the arbiter was asked about."""
    asked = resolved.where(F.col("outcome").isin("arbiter_selected", "arbiter_abstained")).join(answers, "profile_id")
    won = F.col("outcome") == "arbiter_selected"
    prefix = (
        F.when(F.col("winner_index").isNull(), "arbiter abstained").when(F.col("error"), "arbiter error")
        .otherwise(F.concat(F.lit("arbiter selected index="), F.col("winner_index").cast("string")))
    )
    return asked.select(
        "profile_id", "linkedin_url", F.lit(0).alias("score"), F.array(F.lit("arbiter_called")).alias("anchors_positive"),
        _no_words().alias("anchors_negative"), F.when(won, "accept").otherwise("ambiguous").alias("decision"),
        F.concat(prefix, F.lit(" (confidence="), F.col("answer_confidence"), F.lit(", reason="), F.col("answer_reason"), F.lit(")")).alias("reason"))


# --- evidence met on the way ---------------------------------------------------------------------
def capture_evidence(results: DataFrame) -> DataFrame:
    """Results that are no profile and no broker page, once per profile and URL."""
    url = F.lower(trim_all(F.col("url")))
    kept = results.where((url != "") & ~F.contains(url, F.lit("linkedin.com")) & ~has_any(url, CAPTURE_BLOCKED))
    cut = kept.select(
        "profile_id", "pos", trim_all(F.col("url")).alias("url"), clip(F.col("title"), 200).alias("title"),
        clip(F.col("description"), 400).alias("description"), F.col("label").alias("source"),
        loose_url_key(trim_all(F.col("url"))).alias("url_key"))
    return first_per_key(cut, ["profile_id", "url_key"], ["pos"], ["pos", "url", "title", "description", "source"])


def grade_evidence(evidence: DataFrame, people: DataFrame) -> DataFrame:
    """Adds ``grade``: strong, medium or none, by source, own domain, slug and snippet."""
    words = split_words(F.lower("name"))
    who = people.select(
        F.col("id").alias("profile_id"), F.coalesce(F.get(words, 0), _empty()).alias("_first"),
        F.when(F.size(words) > 1, F.get(words, F.size(words) - 1)).otherwise("").alias("_last"),
        base_domain(F.col("email")).alias("_base"))
    first, last, url = F.col("_first"), F.col("_last"), F.lower("url")
    shown = F.lower(F.concat_ws(" ", text("title"), text("description")))
    full = (first != "") & (last != "")
    slugs = F.array(*[F.concat(a, F.lit(mark), b) for a, mark, b in (
        (first, "-", last), (first, "_", last), (first, ".", last), (first, "", last), (last, "-", first), (last, "", first))])
    slug_hit = F.exists(slugs, lambda s: (F.length(s) >= 7) & F.contains(url, s))
    own = (F.col("_base") != "") & ~F.col("_base").isin(UNGRADED_DOMAINS) & F.contains(url, F.col("_base"))
    grade = (
        F.when((F.col("source") == "email-exact") | own | (full & slug_hit), "strong")
        .when(full & F.contains(shown, first) & F.contains(shown, last), "medium").otherwise("none")
    )
    return evidence.join(who, "profile_id").withColumn("grade", grade).drop("_first", "_last", "_base")


def assign_evidence(graded: DataFrame, people: DataFrame, most: int = 20) -> DataFrame:
    """Where each kept URL goes: a free primary slot, the other links, or text only.

    A URL that the profile's other_links have already, in any spelling, gets no slot. Looks at the first ``most`` URLs of a profile, which is part of the rule.
    """
    seen = top_per_key(graded, ["profile_id"], [F.asc("pos")], most, "place").where(F.col("grade") != "none")
    url = F.lower("url")
    want = (
        F.when(F.col("grade") != "strong", "").when(F.contains(url, F.lit("github.com")), "other_links")
        .when(url.rlike(r"twitter\.com|://x\.com/"), "twitter_url")
        .when(url.rlike(r"substack\.com|\.edu/|medium\.com|scholar\.google"), "other_links").otherwise("website_url")
    )
    wanted = seen.withColumn("want", want)
    filled = people.select(F.col("id").alias("profile_id"), (text("twitter_url") != "").alias("_t"), (text("website_url") != "").alias("_w"))
    leads = wanted.where(F.col("want").isin("twitter_url", "website_url")).groupBy("profile_id", "want").agg(F.min("place").alias("_lead"))
    taken = ((F.col("want") == "twitter_url") & F.col("_t")) | ((F.col("want") == "website_url") & F.col("_w"))
    slot = F.when(F.col("_lead").isNull(), F.col("want")).when(taken | (F.col("place") != F.col("_lead")), "other_links").otherwise(F.col("want"))
    joined = wanted.join(leads, ["profile_id", "want"], "left").join(filled, "profile_id")
    if "other_links" in people.columns:
        listed = people.select(F.col("id").alias("profile_id"), F.explode("other_links").alias("_link")).select(
            "profile_id", evidence_url_key(F.col("_link")).alias("_key"), F.lit(True).alias("_listed")).distinct()
        joined = joined.withColumn("_key", evidence_url_key(F.col("url"))).join(listed, ["profile_id", "_key"], "left")
        slot = F.when((slot == "other_links") & F.col("_listed"), "").otherwise(slot)
    return joined.select(
        "profile_id", "place", "url", "grade", slot.alias("slot"),
        F.concat(F.lit("search_evidence("), F.col("grade"), F.lit("):"), F.left("url", F.lit(80))).alias("text_key"),
        trim_all(F.concat_ws("\n", text("title"), text("description"))).alias("snippet"))
