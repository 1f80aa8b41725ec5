"""Reruns, digests, chained stream phases, windows with late rows, and Markdown reports."""

from datetime import datetime

from pyspark.sql import functions as F

from rollcall.operators import candidates, ranking, reports, rerun, upkeep
from rollcall.sources import store
from rollcall.streaming import jobs


def test_every_list_shapes_the_digest(spark):
    searches = spark.createDataFrame([("a", "d", "find bakers", "")], "search_id STRING, dataset_id STRING, query STRING, clarification_context STRING")
    rules = spark.createDataFrame([("a", 1, "no chains")], "search_id STRING, rule_no INT, rule STRING")
    exemplar = lambda reason: spark.createDataFrame([("a", 0, "p1", 95, reason)], "search_id STRING, place INT, profile_id STRING, score INT, reason STRING")
    fix = lambda t: spark.createDataFrame([("a", 1, t)] if t else [], "search_id STRING, place INT, correction STRING")
    digest = lambda *lists: ranking.with_prompt_hash(searches, rules, *lists).first().prompt_hash
    seen = {digest(exemplar(r), fix(t)) for r in ("good", "bad") for t in ("", "CORRECTION: x", "CORRECTION: y")}
    assert len(seen) == 6 and digest() == digest() and len(digest()) == 16


def test_rerun_scores_only_what_changed(spark):
    schema = "search_id STRING, dataset_id STRING, query STRING"
    searches = spark.createDataFrame([("a", "d", "baker"), ("b", "d", "baker"), ("c", "none", "baker")], schema)
    rules = spark.createDataFrame([("a", 1, "r"), ("b", 1, "r")], "search_id STRING, rule_no INT, rule STRING")
    lists = "search_id STRING, place INT, profile_id STRING, score INT, reason STRING"
    none = spark.createDataFrame([], lists)
    people = spark.createDataFrame([("p1", "d", "a baker"), ("p2", "d", None), ("p3", "e", "baker")], "id STRING, dataset_id STRING, profile_card STRING")
    hashed = ranking.with_prompt_hash(searches, rules, none)
    before = hashed.crossJoin(people.select(F.col("id").alias("profile_id"))).select("search_id", "profile_id", "prompt_hash", F.lit(7).alias("score"))
    proposal = rerun.Proposal(
        spark.createDataFrame([], "search_id STRING, add_no INT, rule STRING"),
        spark.createDataFrame([], "search_id STRING, swap_no INT, old_rule STRING, new_rule STRING"), none,
        spark.createDataFrame([("b", 0, "p1", 95, "good")], lists))
    got = rerun.rerun(searches, rules, none, proposal, people, before).scores.collect()
    assert {(r.search_id, r.profile_id): r.score for r in got} == {("a", "p1"): 7, ("a", "p2"): 7, ("b", "p1"): 100, ("b", "p2"): 0}


def test_phases_go_on_where_they_stopped(spark, tmp_path):
    """A crash in the second phase, then more input: every row comes through each phase once."""
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    put = lambda ids: spark.createDataFrame([(i,) for i in ids], "id LONG").coalesce(1).write.mode("append").parquet(source)
    broken = F.raise_error(F.lit("lost"))
    steps = lambda second: [
        ("one", lambda rows: rows.withColumn("a", F.col("id") * 2)), ("two", lambda rows: rows.withColumn("b", second)),
        ("three", lambda rows: rows.withColumn("c", F.col("b") + 1))]
    live = lambda: jobs.read_files(spark, source, "id LONG")
    put([1, 2])
    try:
        jobs.chained(steps(broken.cast("long")), live(), folder)
        raise AssertionError("the broken phase ended well")
    except AssertionError:
        raise
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    assert spark.read.parquet(f"{folder}/one").count() == 2
    put([3])
    for _ in range(2):
        done = jobs.chained(steps(F.col("a") + 10), live(), folder)
    assert sorted(map(tuple, done.collect())) == [(i, 2 * i, 2 * i + 10, 2 * i + 11) for i in (1, 2, 3)]


def test_windows_with_late_rows(spark, tmp_path):
    """Rows behind the watermark aren't counted; a window's newest version stands; old windows leave the state."""
    source, table, state = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/state"
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    for part in ([(at(0), "Search (a)"), (at(0, 30), "x")], [(at(0, 59), "x"), (at(9), "Search (b)")], [(at(1), "x")], [(at(0), "too late"), (at(9, 5), "x")]):
        spark.createDataFrame(part, "ts TIMESTAMP, line STRING").coalesce(1).write.mode("append").parquet(source)
        query = jobs.write_changed(jobs.hourly_rates(jobs.read_files(spark, source, "ts TIMESTAMP, line STRING")), table, state)
        jobs.run_to_end(query)
    rows = jobs.current_rows(spark.read.parquet(table), "window_start").collect()
    assert {r.window_start.hour: (r.lines, r.searches) for r in rows} == {0: (3, 1), 9: (2, 1)}
    assert query.lastProgress is None or query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_markdown_keeps_order_and_cells(spark, tmp_path):
    report = spark.createDataFrame([("b", 10), ("a|x\ny", 9), (None, 100)], "name STRING, n INT")
    reports.write_markdown(report, f"{tmp_path}/report", [F.col("n")])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert lines == ["| name | n |", "| --- | --- |", "| a\\|x y | 9 |", "| b | 10 |", "|  | 100 |"]


def test_fetch_and_reset_on_the_stored_shape(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", "https://x.com/a", '{"website": "t"}', "done"), ("2", "https://x.com/b", "{}", "done"), ("3", "", "", "done"), ("4", "https://x.com/c", None, None)],
        "id STRING, twitter_url STRING, fetched_content STRING, profile_card STRING")
    owned = rows.withColumns({"account_id": F.lit("a"), "dataset_id": F.lit("d")})
    store.save_profiles(store.conform(owned), str(tmp_path / "people"))
    loaded = store.load_profiles(spark, str(tmp_path / "people"), "a")
    assert {r.id for r in upkeep.needs_fetch(loaded).select("id").collect()} == {"2", "4"}
    reset = upkeep.reset_for_rerun(loaded)
    assert reset.schema["fetched_content"].dataType == loaded.schema["fetched_content"].dataType
    assert {(r.enrichment_status, len(r.fetched_content), r.profile_card) for r in reset.collect()} == {("pending", 0, "")}


def test_stored_links_get_no_slot(spark):
    graded = spark.createDataFrame([("p", 0, "https://github.com/me/", "strong", "t", "d"), ("p", 1, "https://github.com/you", "strong", "t", "d")],
                                   "profile_id STRING, pos INT, url STRING, grade STRING, title STRING, description STRING")
    people = spark.createDataFrame([("p", "", "", ["HTTPS://GitHub.com/me"])], "id STRING, twitter_url STRING, website_url STRING, other_links ARRAY<STRING>")
    got = {r.url: r.slot for r in candidates.assign_evidence(graded, people).collect()}
    assert got == {"https://github.com/me/": "", "https://github.com/you": "other_links"}


def test_keywords_count_inside_a_row(spark):
    body = "alpha beta alpha beta gamma delta delta delta " * 3
    fields = spark.createDataFrame([("p", "bio", body), ("p", "note", "short"), ("q", "bio", None), ("r", "bio", "the and of with this that from the and of")],
                                   "profile_id STRING, field_name STRING, body STRING")
    got = {r.profile_id: r.content_keywords for r in candidates.keywords(fields).collect()}
    assert set(got) <= {"p", "r"} and got["p"][:3] == ["alpha beta", "delta delta", "beta alpha"][:1] + got["p"][1:3] and "delta" in got["p"]
