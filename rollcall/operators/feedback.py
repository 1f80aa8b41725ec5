"""Feedback on search results: exemplars, exclusions, rule edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import MAX_EXEMPLARS
from rollcall.functions.text import first_filled
from rollcall.operators.keyed import first_per_key, last_per_key, top_per_key

# What a rating makes of a profile.
EXEMPLAR_SCORES = {"strong_yes": 95, "no": 5, "strong_no": 5}
DEFAULT_REASONS = {"strong_yes": "Marked as excellent", "no": "Rejected without reason", "strong_no": "Rejected without reason"}


def exemplar_offers(feedback: DataFrame) -> DataFrame:
    """Feedback that offers an exemplar, with its score and reason; plain approval offers none."""
    score = F.coalesce(*[F.when(F.col("rating") == r, F.lit(s)) for r, s in EXEMPLAR_SCORES.items()])
    reason = F.coalesce(*[F.when(F.col("rating") == r, F.lit(t)) for r, t in DEFAULT_REASONS.items()])
    return feedback.withColumns({"score": score, "reason": first_filled(F.trim("reason"), reason)}).where("score IS NOT NULL")


def offers_of_known(feedback: DataFrame, people: DataFrame, longest: int = 300) -> DataFrame:
    """Exemplar offers for profiles that exist, with their name and the beginning of their text for prompts.

    ``people``: id, name, raw_text.
    """
    known = people.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"),
                          F.left("raw_text", F.lit(longest)).alias("profile_summary"))
    return exemplar_offers(feedback).join(known, "profile_id")


def prompt_corrections(feedback: DataFrame, people: DataFrame) -> DataFrame:
    """Corrections to a search's prompt, each once: search_id, correction, place (the first event that has it).

    ``feedback`` has reasoning_correction, what a user changed, and prompt_correction, what was
    made of it; an event without either, or for a profile that doesn't exist, corrects nothing.
    """
    known = people.select(F.col("id").alias("profile_id"))
    edited = feedback.where((F.trim("reasoning_correction") != "") & (F.trim("prompt_correction") != ""))
    return edited.join(known, "profile_id", "left_semi").groupBy("search_id", F.col("prompt_correction").alias("correction")).agg(
        F.min("event_id").alias("place"))


def latest_opinions(feedback: DataFrame) -> DataFrame:
    """Newest exemplar offer per search and profile."""
    return last_per_key(exemplar_offers(feedback), ["search_id", "profile_id"], ["created_at", "event_id"], ["score", "reason", "created_at"])


def exclusions(feedback: DataFrame) -> DataFrame:
    """Profiles a strong rejection hides from a search."""
    return feedback.where(F.col("rating") == "strong_no").select("search_id", "profile_id").distinct()


def feedback_counts(searches: DataFrame, feedback: DataFrame) -> DataFrame:
    counts = feedback.groupBy("search_id").agg(F.count("*").alias("n_feedback"))
    return searches.join(counts, "search_id", "left").withColumn("n_feedback", F.coalesce("n_feedback", F.lit(0)))


def edit_rules(rules: DataFrame, added: DataFrame, replaced: DataFrame) -> DataFrame:
    """Rule list after a proposal: replacements in place, new rules at the end.

    ``rules``: search_id, rule_no, rule. ``added``: search_id, add_no, rule. ``replaced``:
    search_id, swap_no, old_rule, new_rule; of several for one rule the lowest swap_no counts.
    A rule already on the list is not added again.
    """
    swaps = first_per_key(replaced.select("search_id", F.col("old_rule").alias("rule"), F.col("new_rule").alias("_new"), "swap_no"),
                          ["search_id", "rule"], ["swap_no", "_new"], ["_new"])
    fresh = added.where(F.trim("rule") != "").join(rules.select("search_id", "rule").distinct(), ["search_id", "rule"], "left_anti")
    fresh = fresh.groupBy("search_id", "rule").agg(F.min("add_no").alias("add_no"))
    ends = rules.groupBy("search_id").agg(F.max("rule_no").alias("_end"))
    tail = fresh.join(ends, "search_id", "left").select(
        "search_id", (F.coalesce("_end", F.lit(0)) + F.col("add_no")).alias("rule_no"), "rule")
    listed = rules.select("search_id", "rule_no", "rule").unionByName(tail)
    return listed.join(swaps, ["search_id", "rule"], "left").select("search_id", "rule_no", F.coalesce("_new", "rule").alias("rule"))


def edit_exemplars(exemplars: DataFrame, removed: DataFrame, offered: DataFrame, most: int = MAX_EXEMPLARS) -> DataFrame:
    """Exemplar list after a proposal: removals, then offers while there is room.

    ``exemplars`` and ``offered``: search_id, place, profile_id, score, reason. The limit is
    a rule of the list; an offer for a profile already listed is left out.
    """
    kept = exemplars.join(removed.select("search_id", "profile_id").distinct(), ["search_id", "profile_id"], "left_anti")
    new = offered.join(kept.select("search_id", "profile_id"), ["search_id", "profile_id"], "left_anti")
    new = first_per_key(new, ["search_id", "profile_id"], ["place"], ["place", "score", "reason"])
    room = kept.groupBy("search_id").agg(F.count("*").alias("_n"))
    first = top_per_key(new, ["search_id"], [F.asc("place"), F.asc("profile_id")], most, "_rank").join(room, "search_id", "left")
    fits = first.where(F.col("_rank") <= most - F.coalesce("_n", F.lit(0)))
    return kept.unionByName(fits.select(*kept.columns))
