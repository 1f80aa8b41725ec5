"""Connected components by label propagation with pointer jumping, each round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is linked to over any number of links.

    ``links`` has columns a and b of one orderable type. A round takes the smallest label
    among neighbours and then that label's own label; it ends when nothing changes.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialised(links.select(F.explode(ends).alias("x")).select("x.a", "x.b"), "links")
    labels = materialised(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select(
            "node", "old", F.least("label", "next").alias("label"))
        labels = materialised(jumped, "labels")
        if labels.where("label < old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
