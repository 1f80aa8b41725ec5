"""Scoring cards against a search, ranked results, request texts, ranking quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import CARD_CHARS
from rollcall.functions.text import clip, first_filled, prompt_hash, text, word_tokens
from rollcall.functions.urls import harvest_urls
from rollcall.functions.vectors import dot, norm
from rollcall.operators.keyed import BATCH_DIGITS, first_per_key, number_batches, top_per_key

JUDGE_BATCH = 40


# --- scoring -------------------------------------------------------------------------------
def term_scores(cards: DataFrame, searches: DataFrame, search_id: str) -> DataFrame:
    """Default scorer: share of the query's distinct words that the card contains, 0-100.

    ``cards``: profile_id, profile_card. One search at a time, its words travel in the plan.
    """
    query = searches.where(F.col("search_id") == search_id).select("query").first()
    words = sorted({w for w in (query[0] if query else "").lower().split() if w})
    wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    held = F.size(F.array_intersect(wanted, F.array_distinct(word_tokens(F.lower(text("profile_card"))))))
    score = F.floor(F.lit(100) * held / max(len(words), 1)).cast("int")
    return cards.select(F.lit(search_id).alias("search_id"), "profile_id", score.alias("score"))


def custom_scores(cards: DataFrame, scorer: Callable[[pd.Series], Sequence[int]], search_id: str) -> DataFrame:
    """Scores from a caller's function over batches of card texts, clamped to 0-100."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = pd.Series(list(scorer(batch["profile_card"])))
            yield pd.DataFrame({"search_id": search_id, "profile_id": batch["profile_id"].values,
                                "score": given.clip(0, 100).astype("int32").values})

    return cards.select("profile_id", "profile_card").mapInPandas(run, "search_id STRING, profile_id STRING, score INT")


def with_prompt_hash(
    searches: DataFrame, rules: DataFrame | None = None, exemplars: DataFrame | None = None, corrections: DataFrame | None = None
) -> DataFrame:
    """Searches with the digest of everything that shapes their scores.

    ``rules``: search_id, rule_no, rule — the global rules that apply. ``exemplars``: search_id,
    place, profile_id, score, reason. ``corrections``: search_id, place, correction. A table
    that isn't given is no part of the digest; one that has nothing for a search is an empty part.
    """
    out = searches
    shown = F.concat_ws("\x1d", "profile_id", F.col("score").cast("string"), "reason")
    lists = {"_rules": (rules, "rule_no", F.col("rule")), "_exemplars": (exemplars, "place", shown),
             "_corrections": (corrections, "place", F.col("correction"))}
    for name, (table, place, value) in lists.items():
        if table is not None:
            joined = table.select("search_id", F.struct(F.col(place).alias("place"), value.alias("value")).alias("_v")).groupBy("search_id").agg(
                F.array_join(F.transform(F.array_sort(F.collect_list("_v")), lambda r: r["value"]), "\x1e").alias(name))
            out = out.join(joined, "search_id", "left")
    parts = [F.col(c) for c in ("query", "clarification_context", "rules_text", *lists) if c in out.columns]
    return out.withColumn("prompt_hash", prompt_hash(*parts)).drop(*lists)


def overlap_scores(asked: DataFrame) -> DataFrame:
    """``asked`` (query, profile_card and more) with ``score``: the share of the query's distinct words in the card, 0-100."""
    words = F.filter(F.array_distinct(F.split(F.lower(text("query")), r"\s+")), lambda w: w != "")
    held = F.size(F.array_intersect(words, F.array_distinct(word_tokens(F.lower(text("profile_card"))))))
    return asked.withColumn("score", F.floor(F.lit(100) * held / F.greatest(F.size(words), F.lit(1))).cast("int"))


def stale_scores(wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """(search, profile, hash) rows that have no score under the present hash."""
    return wanted.join(scores.select("search_id", "profile_id", "prompt_hash").distinct(), ["search_id", "profile_id", "prompt_hash"], "left_anti")


def applicable_rules(rules: DataFrame, chosen: DataFrame) -> DataFrame:
    return rules.join(chosen.select("rule_id").distinct(), "rule_id", "left_semi")


# --- results -------------------------------------------------------------------------------
def rank(scores: DataFrame, people: DataFrame) -> DataFrame:
    """Scored profiles that still exist, best first, then by name."""
    joined = scores.join(people.select(F.col("id").alias("profile_id"), "name"), "profile_id")
    return joined.orderBy("search_id", F.desc("score"), F.asc("name"), F.asc("profile_id"))


def results(scores: DataFrame, people: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row per search and person, the best-scored, with how many rows that person has.

    Excluded rows go first; rows without a person stand for themselves; scores of unknown
    profiles stay, named ``Unknown``. ``people``: id, name, person_id, email, linkedin_url.
    """
    known = people.select(F.col("id").alias("profile_id"), "name", "person_id", "email", "linkedin_url")
    kept = scores.join(excluded.select("search_id", "profile_id").distinct(), ["search_id", "profile_id"], "left_anti")
    joined = kept.join(known, "profile_id", "left").withColumns({
        "name": F.coalesce("name", F.lit("Unknown")),
        "_person": first_filled(F.col("person_id"), F.concat(F.lit("row:"), F.col("profile_id"))), "_down": -F.col("score")})
    sizes = joined.groupBy("search_id", "_person").agg(
        F.count("*").alias("dataset_rows"),
        F.min_by(F.struct("profile_id", "name", "score", text("email").alias("email"), text("linkedin_url").alias("linkedin_url")),
                 F.struct("_down", "profile_id")).alias("_best"))
    return sizes.select("search_id", "_best.*", "dataset_rows")


def excluded_counts(scores: DataFrame, excluded: DataFrame) -> DataFrame:
    """How many scored rows each search hides."""
    hidden = scores.join(excluded.select("search_id", "profile_id").distinct(), ["search_id", "profile_id"], "left_semi")
    return hidden.groupBy("search_id").agg(F.count("*").alias("excluded_count"))


def top_page(ranked: DataFrame, texts: DataFrame, search_id: str, rows: int = 50) -> DataFrame:
    """First page of one search with its links; texts are read for the shown rows only."""
    page = ranked.where(F.col("search_id") == search_id).orderBy(F.desc("score"), F.asc("profile_id")).limit(rows)
    return page.join(texts, "profile_id", "left").withColumn(
        "extra_links", harvest_urls(F.col("raw_text"), F.col("linkedin_url"))).drop("raw_text")


def newest_first(df: DataFrame, stamp: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(stamp), F.desc(key))


# --- request texts ------------------------------------------------------------------------------
def judge_prompts(searches: DataFrame, exemplars: DataFrame, instructions: str = "") -> DataFrame:
    """System text per search in fixed sections; all exemplars, best first.

    ``searches``: search_id, query, clarification_context, global_rules, search_rules and
    corrections (arrays). ``exemplars``: search_id, place, profile_name, profile_summary,
    score, reason.
    """
    shown = F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit(": "), F.col("profile_name"), F.lit(" — "),
                     clip(F.col("profile_summary"), 200), F.lit(' — "'), F.col("reason"), F.lit('"'))
    # The exemplar list of a search is kept short where it is edited, so one value holds it.
    blocks = exemplars.groupBy("search_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), "place", shown.alias("shown")))),
        lambda r: r["shown"]), "\n").alias("_examples"))
    bullets = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{head}:\n"), F.array_join(F.transform(c, lambda r: F.concat(F.lit("- "), r)), "\n")))
    return searches.join(blocks, "search_id", "left").select("search_id", F.concat_ws(
        "\n", F.concat(F.lit("QUERY: "), F.col("query")),
        F.when(text("clarification_context") != "", F.concat(F.lit("\nCONTEXT:\n"), F.col("clarification_context"))),
        bullets("GLOBAL RULES", F.col("global_rules")), bullets("SEARCH RULES", F.col("search_rules")),
        F.when(F.col("_examples").isNotNull(), F.concat(F.lit("\nCALIBRATION EXAMPLES:\n"), F.col("_examples"))),
        bullets("CORRECTIONS", F.col("corrections")), F.nullif(F.lit(instructions), F.lit(""))).alias("system_text"))


def judge_batches(cards: DataFrame, size: int = JUDGE_BATCH, hex_digits: int = BATCH_DIGITS) -> DataFrame:
    """User text per batch of at most ``size`` cards: profile_id, name, profile_card."""
    one = F.concat(F.lit("ID:"), F.col("profile_id"), F.lit("\n"), first_filled(F.col("name"), F.lit("Unknown")), F.lit("\n"),
                   clip(F.col("profile_card"), CARD_CHARS), F.lit("\n---"))
    numbered = number_batches(cards.withColumn("_one", one), "profile_id", size, hex_digits)
    return numbered.groupBy("batch_group", "batch_no").agg(
        F.count("*").alias("n_profiles"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("profile_id", "_one"))), lambda r: r["_one"]), "\n").alias("user_text"))


def arbiter_prompts(people: DataFrame, pools: DataFrame) -> DataFrame:
    """Question text per profile with its offered candidates (at most five).

    ``pools``: profile_id, rank (from 1), url, title, description, score, reasons.
    """
    offered = pools.where(F.col("rank") <= 5)
    line = F.concat_ws(
        "\n", F.concat(F.lit("  ["), (F.col("rank") - 1).cast("string"), F.lit("] "), F.col("url")),
        F.when(text("title") != "", F.concat(F.lit("    title: "), F.col("title"))),
        F.when(text("description") != "", F.concat(F.lit("    snippet: "), clip(F.col("description"), 500))),
        F.concat(F.lit("    heuristic_score: "), F.col("score").cast("string")),
        F.when(F.size("reasons") > 0, F.concat(F.lit("    reasons: "), F.array_join("reasons", ", "))))
    blocks = offered.select("profile_id", "rank", line.alias("line")).groupBy("profile_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]), "\n").alias("_candidates"))
    facts = [F.concat(F.lit(f"  {c}: "), text(c)) for c in ("name", "email", "organization", "title")]
    return people.join(blocks, people["id"] == blocks["profile_id"]).select(
        "profile_id", F.concat_ws("\n", F.lit("PROFILE:"), *facts, F.lit(""), F.lit("CANDIDATES:"), F.col("_candidates")).alias("user_text"))


def transcript_context(turns: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Each conversation as one text of Q/A lines: conv_id, context.

    ``summaries``: conv_id, summary. A summary that is not empty takes the place of the lines.
    """
    line = F.concat(F.when(F.col("role") == "assistant", "Q: ").otherwise("A: "), text("text"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda r: r["line"]), "\n").alias("context"))
    if summaries is None:
        return whole
    summed = F.when(text("summary") != "", F.concat(F.lit("Search clarification summary:\n"), F.col("summary")))
    return whole.join(summaries, "conv_id", "full_outer").select("conv_id", F.coalesce(summed, F.col("context"), F.lit("")).alias("context"))


# --- vectors --------------------------------------------------------------------------------------
def vector_search(vectors: DataFrame, queries: dict[str, Sequence[float]], k: int, id_column: str = "vec_id") -> DataFrame:
    """Top ``k`` rows by cosine for each named query vector (a few, given by the caller)."""
    asked = F.array(*[F.struct(F.lit(n).alias("query"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for n, v in queries.items()])
    pairs = vectors.select(id_column, "embedding", norm(F.col("embedding")).alias("_n")).select("*", F.inline(asked))
    length = F.col("_n") * norm(F.col("q"))
    scored = pairs.select("query", id_column, F.when(length == 0, 0.0).otherwise(dot(F.col("embedding"), F.col("q")) / length).alias("cosine"))
    return top_per_key(scored, ["query"], [F.desc("cosine"), F.asc(id_column)], k)


def mean_vector(vectors: DataFrame) -> list[float]:
    """Mean of a vector column; one aggregated row reaches the driver."""
    cells = vectors.select(F.posexplode("embedding").alias("i", "x"))
    rows = cells.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    return [r["m"] for r in rows]


# --- quality ---------------------------------------------------------------------------------------
def ranking_quality(judged: DataFrame, k: int = 10) -> DataFrame:
    """P@k, reciprocal rank and NDCG@k per query: query_id, item_id, score, relevance (0 or more)."""
    good = F.col("relevance") > 0
    gain = lambda place: (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col(place) + 1)
    shown = top_per_key(judged, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "place")
    best = top_per_key(judged, ["query_id"], [F.desc("relevance"), F.asc("item_id")], k, "place")
    found = shown.groupBy("query_id").agg(F.sum(gain("place")).alias("dcg"), F.count_if(good).alias("hits"))
    ideal = best.groupBy("query_id").agg(F.sum(gain("place")).alias("ideal"))
    top_hit = first_per_key(judged.where(good).withColumn("_down", -F.col("score")), ["query_id"], ["_down", "item_id"], ["score", "item_id"])
    ahead = judged.join(top_hit.select("query_id", F.col("score").alias("_s"), F.col("item_id").alias("_i")), "query_id").groupBy("query_id").agg(
        (F.count_if((F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("item_id") < F.col("_i")))) + 1).alias("first_hit"))
    joined = found.join(ideal, "query_id").join(ahead, "query_id", "left")
    return joined.select(
        "query_id", F.round(F.col("hits") / k, 6).alias("precision_at_k"), F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg_at_k"))


def score_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change between two scorings of the same search and profile, summed per search."""
    old = before.select("search_id", "profile_id", F.col("score").alias("_old"))
    gap = F.col("score") - F.col("_old")
    return after.join(old, ["search_id", "profile_id"]).groupBy("search_id").agg(
        F.count("*").alias("n"), F.count_if(gap != 0).alias("changed"), F.round(F.avg(gap.cast("double")), 6).alias("mean_shift"),
        F.round(F.avg(F.abs(gap).cast("double")), 6).alias("mean_abs_shift"))


def with_subject(feedback: DataFrame, people: DataFrame, scores: DataFrame) -> DataFrame:
    """Feedback with the name and score of the profile it is about."""
    return feedback.join(people.select(F.col("id").alias("profile_id"), "name"), "profile_id", "left").join(
        scores.select("search_id", "profile_id", "score"), ["search_id", "profile_id"], "left")


def bad_in_top(judged: DataFrame, k: int = 10) -> DataFrame:
    """Items of no relevance among the first ``k`` of each query."""
    shown = top_per_key(judged, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "place")
    return shown.groupBy("query_id").agg(F.count_if(F.col("relevance") <= 0).alias("bad"))
