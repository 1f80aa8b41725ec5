"""Keyed building blocks that hold up when one key owns a large share of the rows.

``first``/``last`` are plain aggregates, so a hot key shrinks before the shuffle. Top-k
ranks are written in the form Catalyst turns into a per-task limit ahead of the shuffle.
Running sums and batch numbers work on slices of a key, never on a whole key at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Digest digits that name a batch group: 256 groups.
BATCH_DIGITS = 2


def _payload(df: DataFrame, keys: list[str], columns: list[str] | None) -> list[str]:
    return columns or [c for c in df.columns if c not in keys]


def _pick(df: DataFrame, keys, order, columns, chooser) -> DataFrame:
    kept = _payload(df, keys, columns)
    return (
        df.groupBy(*keys)
        .agg(chooser(F.struct(*kept), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in kept])
    )


def first_per_key(df: DataFrame, keys: list[str], order: list, columns: list[str] | None = None) -> DataFrame:
    """One row per key, the smallest by ``order`` (ascending, ties impossible by contract)."""
    return _pick(df, keys, order, columns, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list, columns: list[str] | None = None) -> DataFrame:
    return _pick(df, keys, order, columns, F.max_by)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key with their rank."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def running_sums(
    df: DataFrame, keys: list[str], position: str, amounts: dict[str, Column], chunk: int = 65536
) -> DataFrame:
    """Inclusive running sums per key in ``position`` order (an integer, unique per key).

    A key is cut into slices of ``chunk`` positions. Each slice is summed on its own and
    only one row per slice takes part in the pass over the whole key. For every amount a
    column of its name and one with the suffix ``_total``, the sum over the key, are added.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(position) / chunk))
    sliced = sliced.withColumns({f"_x_{n}": a.cast("long") for n, a in amounts.items()})
    inside = W.partitionBy(*keys, "_slice").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.withColumns({f"_l_{n}": F.sum(f"_x_{n}").over(inside) for n in amounts})
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in amounts])
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in amounts],
        *[F.sum(f"_t_{n}").over(W.partitionBy(*keys)).alias(f"{n}_total") for n in amounts])
    return local.join(offsets, [*keys, "_slice"]).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in amounts], *[f"{n}_total" for n in amounts])


def number_batches(df: DataFrame, id_column: str, size: int, hex_digits: int = BATCH_DIGITS) -> DataFrame:
    """Batches of at most ``size`` rows for an outside service.

    Rows are spread over ``16 ** hex_digits`` groups by a digest of the id and numbered
    inside each, so no task sorts the whole table. The number of digits is fixed, so a row
    keeps its group however large the table grows. Adds batch_group and batch_no.
    """
    grouped = df.withColumn("batch_group", F.left(F.md5(F.col(id_column).cast("string")), F.lit(hex_digits)))
    numbered = F.row_number().over(W.partitionBy("batch_group").orderBy(id_column))
    return grouped.withColumn("batch_no", F.floor((numbered - 1) / size).cast("int"))


def order_statistics(
    counted: DataFrame, keys: list[str], value: str, weight: str, ranks: dict[str, Callable[[Column], Column]], cells: int = 128
) -> DataFrame:
    """Exact values at given ranks of every key, from its distinct values.

    ``counted`` has a row per key and distinct value and how many rows have it (``weight``);
    ``ranks`` gives for each name the place (from 0) in a key of so many rows. A key's values
    are cut into ``cells`` ranges of about as many distinct values each; the rows per range say
    in which of them a rank lies, and only that range is put in order. So no task orders more
    than a share of one key. Gives keys, n and the named values; null values have no place.
    """
    counted = counted.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"))
    edges = counted.groupBy(*keys).agg(
        F.percentile_approx("_v", [i / cells for i in range(1, cells)], 10 * cells).alias("_edges"), F.sum("_w").alias("n"))
    celled = counted.join(edges, keys).withColumn("_cell", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    below = F.coalesce(F.sum("_held").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_cell = celled.groupBy(*keys, "n", "_cell").agg(F.sum("_w").alias("_held")).withColumn("_below", below)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in ranks.items()])
    # A rank lies in the one cell whose rows reach over it.
    inside = F.filter(wanted, lambda w: (F.col("_below") <= w["place"]) & (w["place"] < F.col("_below") + F.col("_held")))
    sought = per_cell.withColumn("_sought", inside).where(F.size("_sought") > 0).select(*keys, "_cell", "_below", "_sought")
    upto = F.col("_below") + F.sum("_w").over(W.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ordered = celled.join(sought, [*keys, "_cell"]).withColumn("_upto", upto)
    hits = ordered.select(*keys, "n", "_v", F.explode(F.filter(
        "_sought", lambda w: (w["place"] < F.col("_upto")) & (w["place"] >= F.col("_upto") - F.col("_w")))).alias("hit"))
    return hits.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("hit.name") == name, F.col("_v"))).alias(name) for name in ranks])
