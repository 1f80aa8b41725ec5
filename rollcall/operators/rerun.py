"""A search run again after feedback: proposals applied, then only what changed is scored anew."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.feedback import edit_exemplars, edit_rules
from rollcall.operators.ranking import overlap_scores, stale_scores, with_prompt_hash


class Proposal(NamedTuple):
    """What was learnt from feedback: see :func:`edit_rules` and :func:`edit_exemplars` for the columns."""

    added_rules: DataFrame
    replaced_rules: DataFrame
    removed_exemplars: DataFrame
    offered_exemplars: DataFrame


class Rerun(NamedTuple):
    """The searches' lists and digests after a rerun, and a score for every profile in their scope."""

    rules: DataFrame
    exemplars: DataFrame
    searches: DataFrame
    scores: DataFrame


def rescored(searches: DataFrame, profiles: DataFrame, scores: DataFrame, score: Callable[[DataFrame], DataFrame] = overlap_scores) -> DataFrame:
    """search_id, profile_id, prompt_hash and score of every search for the profiles of its dataset.

    ``searches``: search_id, dataset_id, query, prompt_hash. ``profiles``: id, dataset_id,
    profile_card. Scores under the present digest stay; pairs without one go to ``score``, which
    adds a score column. Scores of profiles that are gone, or under another digest, go.
    """
    cards = profiles.select(F.col("id").alias("profile_id"), "dataset_id", "profile_card")
    wanted = searches.select("search_id", "dataset_id", "query", "prompt_hash").join(cards, "dataset_id")
    columns = ["search_id", "profile_id", "prompt_hash", "score"]
    kept = scores.join(wanted.select(*columns[:3]), columns[:3], "left_semi").select(*columns)
    return kept.unionByName(score(stale_scores(wanted, scores)).select(*columns))


def rerun(
    searches: DataFrame, rules: DataFrame, exemplars: DataFrame, proposal: Proposal, profiles: DataFrame, scores: DataFrame,
    corrections: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] = overlap_scores,
) -> Rerun:
    """Applies a proposal to the lists of searches, works out their digests and rescores what became stale.

    A search whose rules, exemplars and corrections come out as they were keeps its scores.
    """
    rules = edit_rules(rules, proposal.added_rules, proposal.replaced_rules)
    exemplars = edit_exemplars(exemplars, proposal.removed_exemplars, proposal.offered_exemplars)
    hashed = with_prompt_hash(searches, rules, exemplars, corrections)
    return Rerun(rules, exemplars, hashed, rescored(hashed, profiles, scores, score))
