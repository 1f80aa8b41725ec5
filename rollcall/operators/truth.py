"""Agreement with hand-labelled ground truth, and the sample to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.emails import sampler_cohort
from rollcall.functions.text import guarded_ratio, text
from rollcall.functions.urls import truth_url_key
from rollcall.operators.keyed import top_per_key

FIELDS = ["linkedin", "website", "twitter"]


def score_fields(people: DataFrame, truth: DataFrame) -> DataFrame:
    """TP/FP/FN/TN, precision, recall and F1 per field; a wrong URL counts twice over."""
    labelled = truth.select("profile_id", *[F.col(f"true_{f}_url").alias(f"_{f}") for f in FIELDS])
    joined = people.join(labelled, people["id"] == labelled["profile_id"])
    cells = F.array(*[F.struct(
        F.lit(f).alias("field"), truth_url_key(F.col(f"{f}_url")).alias("said"), truth_url_key(F.col(f"_{f}")).alias("real")) for f in FIELDS])
    said, real = F.col("said") != "", F.col("real") != ""
    same = F.col("said") == F.col("real")
    counted = joined.select(F.inline(cells)).groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(said & real & same).alias("tp"), F.count_if(said & ~(real & same)).alias("fp"),
        F.count_if(real & ~(said & same)).alias("fn"), F.count_if(~said & ~real).alias("tn"),
        F.count_if(said & real & ~same).alias("wrong_person"))
    precision = guarded_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = guarded_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return counted.withColumns({"precision": F.round(precision, 3), "recall": F.round(recall, 3), "f1": F.round(f1, 3)})


def hidden_accuracy(people: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of labelled people whose having no URL agrees with being hidden."""
    joined = people.join(truth.select("profile_id", "true_is_hidden"), people["id"] == F.col("profile_id"))
    none = F.lit(True)
    for f in FIELDS:
        none = none & (text(f"{f}_url") == "")
    agrees: Column = none == F.col("true_is_hidden")
    return joined.agg(F.count("*").alias("n"), F.count_if(agrees).alias("correct")).withColumn(
        "hidden_accuracy", F.round(guarded_ratio(F.col("correct"), F.col("n")), 3))


def stratified_sample(people: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` profiles spread over cohorts, topped up from the rest; a seeded digest decides."""
    marked = people.withColumns({
        "cohort": sampler_cohort(F.col("email"), F.col("organization")), "_draw": F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")))})
    cohorts = marked.select("cohort").distinct().count()  # a handful by construction
    per_cohort = max(1, n // max(cohorts, 1))
    first = top_per_key(marked, ["cohort"], [F.asc("_draw"), F.asc("id")], per_cohort, "_place")
    rest = marked.join(first.select("id"), "id", "left_anti").withColumn("_place", F.lit(per_cohort + 1))
    both = first.withColumn("_turn", F.lit(0)).unionByName(rest.withColumn("_turn", F.lit(1)))
    return both.orderBy("_turn", "_draw", "id").limit(n).drop("_turn", "_draw", "_place")
