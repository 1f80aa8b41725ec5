"""Keyed blocks against plain Python, with one key owning a third of the rows."""

import random

from pyspark.sql import functions as F

from rollcall.operators import keyed


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(200)}", i, rng.randrange(50)) for i in range(n)]


def test_running_sums_cross_slices(spark):
    data = rows()
    df = spark.createDataFrame(data, "k STRING, pos LONG, x LONG")
    got = {(r.k, r.pos): r.s for r in keyed.running_sums(df, ["k"], "pos", {"s": F.col("x")}, chunk=64).collect()}
    sums, want = {}, {}
    for k, pos, x in data:
        sums[k] = sums.get(k, 0) + x
        want[(k, pos)] = sums[k]
    assert got == want


def test_first_last_top(spark):
    data = rows()
    df = spark.createDataFrame(data, "k STRING, pos LONG, x LONG")
    by_key = {}
    for k, pos, x in data:
        by_key.setdefault(k, []).append((pos, x))
    assert {r.k: r.pos for r in keyed.first_per_key(df, ["k"], ["x", "pos"]).collect()} == {
        k: min(v, key=lambda t: (t[1], t[0]))[0] for k, v in by_key.items()}
    assert {r.k: r.pos for r in keyed.last_per_key(df, ["k"], ["pos"]).collect()} == {k: max(v)[0] for k, v in by_key.items()}
    top = keyed.top_per_key(df, ["k"], [F.desc("x"), F.asc("pos")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in top.collect():
        got.setdefault(r.k, []).append((r.rank, r.pos))
    assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == {
        k: [p for p, _ in sorted(v, key=lambda t: (-t[1], t[0]))[:3]] for k, v in by_key.items()}


def test_batches_are_bounded_and_complete(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    out = keyed.number_batches(df, "id", 40, 1)
    sizes = [r["count"] for r in out.groupBy("batch_group", "batch_no").count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 5000


def test_order_statistics(spark):
    """Ranks of keys with ties, one value, many values and nulls, against sorting."""
    draw = random.Random(4)
    rows = [("many", draw.uniform(-5, 5)) for _ in range(900)] + [("ties", float(draw.randrange(3))) for _ in range(400)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("some", None), ("some", 7.0), ("none", None)]
    counted = spark.createDataFrame(rows, "k STRING, v DOUBLE").groupBy("k", "v").agg(F.count("*").alias("n"))
    got = keyed.order_statistics(counted, ["k"], "v", "n", {
        "least": lambda n: F.lit(0), "low": lambda n: F.floor((n - 1) / 2), "most": lambda n: n - 1}, cells=16).collect()
    values = {k: sorted(v for j, v in rows if j == k and v is not None) for k, _ in rows}
    assert {r.k: (r.n, r.least, r.low, r.most) for r in got} == {
        k: (len(v), v[0], v[(len(v) - 1) // 2], v[-1]) for k, v in values.items() if v}
