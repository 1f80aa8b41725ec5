"""Reading the stored answers of scoring models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import first_filled, text, trim_all


def _between(body: Column, left: str, right: str) -> Column:
    """From the first ``left`` to the last ``right``, else null."""
    return F.nullif(F.regexp_extract(body, rf"(?s)(\{left}.*\{right})", 1), F.lit(""))


def parse_arbiter(responses: DataFrame, most_candidates: int | None = None) -> DataFrame:
    """Answer per profile: winner_index (null = abstained), answer_confidence, answer_reason, error.

    ``responses``: profile_id, text and, where known, n_candidates; an index outside the
    offered ones counts as abstaining.
    """
    body = trim_all(F.col("text"))
    whole = F.try_parse_json(body)
    parsed = F.coalesce(whole, F.try_parse_json(_between(body, "{", "}")))
    read = lambda key: F.try_variant_get(F.col("_v"), f"$.{key}", "string")
    winner = F.try_variant_get(F.col("_v"), "$.winner_index", "int")
    offered = F.col("n_candidates") if "n_candidates" in responses.columns else F.lit(most_candidates)
    inside = winner.isNotNull() & (winner >= 0) & (offered.isNull() | (winner < offered))
    confidence = F.lower(first_filled(read("confidence"), F.lit("low")))
    failed = F.col("_v").isNull()
    return responses.withColumn("_v", parsed).select(
        "profile_id", F.when(inside, winner).alias("winner_index"),
        F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("low").alias("answer_confidence"),
        F.when(failed, F.concat(F.lit("arbiter_parse_error: "), F.left(body, F.lit(100))))
        .otherwise(first_filled(trim_all(read("reason")), F.lit("no-reason"))).alias("answer_reason"), failed.alias("error"))


def parse_judge(responses: DataFrame) -> DataFrame:
    """Scores in landed judge answers: batch_id, profile_id, score 0-100, reasoning.

    Takes an array of objects or an object of id to number or object, fenced or with text
    around it. The last entry of an id within a batch counts.
    """
    body = F.col("text")
    parsed = F.coalesce(F.try_parse_json(body), F.try_parse_json(_between(body, "[", "]")), F.try_parse_json(_between(body, "{", "}")))
    rows = responses.select("batch_id", F.to_json(parsed).alias("j"))
    item = "STRUCT<id: STRING, s: DOUBLE, score: DOUBLE, r: STRING, reasoning: STRING>"
    as_list = F.when(F.startswith("j", F.lit("[")), F.from_json("j", f"ARRAY<{item}>"))
    as_map = F.map_entries(F.when(F.startswith("j", F.lit("{")), F.from_json("j", "MAP<STRING, STRING>")))
    inner = lambda v: F.from_json(v, item)

    def entry(pid: Column, score: Column, why: Column) -> Column:
        bounded = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(score, F.lit(0.0)).cast("int")))
        return F.struct(text(pid).alias("profile_id"), bounded.alias("score"), text(why).alias("reasoning"))

    from_list = F.transform(as_list, lambda x: entry(x["id"], F.coalesce(x["s"], x["score"]), F.coalesce(x["r"], x["reasoning"])))
    from_map = F.transform(as_map, lambda e: F.when(
        F.startswith(e["value"], F.lit("{")),
        entry(e["key"], F.coalesce(inner(e["value"])["s"], inner(e["value"])["score"]), F.coalesce(inner(e["value"])["r"], inner(e["value"])["reasoning"])),
    ).otherwise(entry(e["key"], e["value"].try_cast("double"), F.lit(""))))
    entries = rows.select("batch_id", F.posexplode(F.coalesce(from_list, from_map)).alias("n", "e"))
    return entries.groupBy("batch_id", F.col("e.profile_id").alias("profile_id")).agg(
        F.max_by(F.struct("e.score", "e.reasoning"), "n").alias("last")).select(
        "batch_id", "profile_id", "last.score", "last.reasoning")


def judge_scores(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Score of every profile sent in a batch; zero where the answer left it out.

    ``batches``: batch_id, profile_id.
    """
    return batches.join(parse_judge(responses), ["batch_id", "profile_id"], "left").select(
        "batch_id", "profile_id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))
