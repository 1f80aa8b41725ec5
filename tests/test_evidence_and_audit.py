"""Evidence rules, log attempts and name comparison against small expectations and brute force."""

import random

from pyspark.sql import functions as F

from rollcall.functions import names
from rollcall.operators import attempts, audit, evidence, upkeep

EV = "profile_id STRING, pos LONG, url STRING, source STRING, kind STRING, anchors ARRAY<STRING>, snippet STRING, title STRING"


def test_merge_and_verdict(spark):
    rows = [
        ("a", 1, "https://X.example/p?q=1", "org_site", "bio", ["name_match"], "s", ""), ("a", 2, "https://x.example/p/", "github", "github", ["slug_match"], "longer", "T"),
        ("b", 1, "https://y.example", "org_site", "bio", ["name_match"], "", ""), ("b", 2, "https://z.example", "github", "github", ["name_match"], "", ""),
        ("c", 1, "https://y.example", "github", "github", ["name_match"], "", ""), ("c", 2, "https://z.example", "github", "github", ["name_match"], "", ""),
        ("d", 1, "https://y.example", "github", "github", [], "", "")]
    merged = evidence.merge_evidence(spark.createDataFrame(rows, EV))
    first = merged.where("profile_id = 'a'").collect()
    assert len(first) == 1 and first[0].anchors == ["name_match", "slug_match"] and first[0].snippet == "longer" and first[0].source == "org_site"
    people = spark.createDataFrame([(i,) for i in "abcde"], "id STRING")
    broken = spark.createDataFrame([("e",), ("a",)], "profile_id STRING")
    assert {r.profile_id: r.state for r in evidence.verdicts(people, merged, broken).collect()} == {
        "a": "enriched", "b": "enriched", "c": "thin", "d": "hidden", "e": "failed"}


def test_signals_of_names_are_worked_out_once(spark, monkeypatch):
    plans, cut = [], evidence.cut_lineage

    def spied(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(evidence, "cut_lineage", spied)
    people = spark.createDataFrame(
        [("a", "Ann Lee", "al@acme.com", "Acme"), ("b", "Jo", "jo@acme.com", None), ("c", None, None, None)],
        "id STRING, name STRING, email STRING, organization STRING")
    html = "<p>Ann Lee leads</p><a href='/people/ann-lee'>Read</a><a href='/jo'>Jo</a>"
    pages = spark.createDataFrame([("https://acme.com/team/1", html), (None, None)], "url STRING, html STRING")
    found = evidence.org_site_evidence(pages, evidence.profile_signals(people)).collect()
    assert [(r["first"], r["last"], r.url) for r in found] == [("ann", "lee", "https://acme.com/people/ann-lee")]
    assert "Filter" not in plans[0]


def test_stage_gate(spark):
    rows = [("a", i, f"https://s{i}.example", src, "bio", ["name_match", "bio_match"], "", "") for i, src in enumerate(["org_site", "github", "linkedin", "open_web"])]
    cut = evidence.stage_cutoffs(spark.createDataFrame(rows, EV)).first()
    assert cut.last_stage == 3
    assert evidence.gate_stages(spark.createDataFrame(rows, EV)).count() == 2


LOG = [
    "noise", "Trying LinkedIn: https://l/in/a/", "  Verify name: MATCH ({x}, strength=strong)", "  Verify org: MISMATCH (x)",
    "  Verify result: ACCEPTED (score=2, checks=1)", "  Verify org: MATCH (late)", "Trying LinkedIn: https://l/in/b", "  Verify name: WEAK-MATCH REJECTED (x)",
    "Trying LinkedIn: https://l/in/c", "  API returned no data (x)", "Trying LinkedIn: https://l/in/d", "  Verify name: MATCH ({x}, strength=weak)"]


def test_attempts(spark):
    df = spark.createDataFrame([("p", i, line) for i, line in enumerate(LOG)], "profile_id STRING, pos LONG, line STRING")
    for chunk in (2, 3, 1000):
        got = [(r.url, r.stored_decision, r.name_strength, r.org_match, r.legacy_log_format, r.raw_score) for r in
               attempts.parse_attempts(df, chunk).orderBy("attempt_no").collect()]
        assert got == [
            ("https://l/in/a", "accepted", "strong", False, True, 2), ("https://l/in/b", "rejected", "none", False, False, 0),
            ("https://l/in/c", "no_data", "none", False, False, 0), ("https://l/in/d", "no_data", "weak", False, False, 0)]
    replayed = attempts.replay_attempts(attempts.parse_attempts(df)).orderBy("attempt_no").collect()
    assert [r.reason for r in replayed] == ["penalty-no-positive", "weak-match-reject"]


def greedy(a, b, alias):
    def same(x, y):
        return x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y))
    used = set()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if j not in used and (same(x, y) or (i == j == 0 and alias)):
                used.add(j)
                break
    return len(used) / (len(a) + len(b) - len(used))


def test_token_overlap_is_greedy(spark):
    rng = random.Random(4)
    pool = ["ann", "a", "bo", "bob", "cy", "dee", "d", "eve"]
    rows = [([rng.choice(pool) for _ in range(rng.randint(1, 4))], [rng.choice(pool) for _ in range(rng.randint(1, 4))], rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(rows, "a ARRAY<STRING>, b ARRAY<STRING>, alias BOOLEAN")
    got = df.select(names.token_overlap(F.col("a"), F.col("b"), F.col("alias")).alias("o")).collect()
    assert [round(r.o, 9) for r in got] == [round(greedy(*r), 9) for r in rows]


def test_audit_flags(spark):
    rows = [("1", "Bob Vell", "Robert Vell"), ("2", "Ana Vell", "Ana Stone"), ("3", "Luka", "Luka Stone"), ("4", "Ana Vell", "Cem Ota"), ("5", "Ana V.", "Ana Vell")]
    df = spark.createDataFrame(rows, "profile_id STRING, uploaded_name STRING, full_name STRING")
    got = {r.profile_id: r.flags for r in audit.audit_pairs(df, audit.alias_table(spark)).collect()}
    assert got == {"2": ["different_last_name", "token_overlap_below_50pct"], "3": ["single_token_uploaded_name"], "4": ["different_last_name", "no_shared_tokens"]}


def test_misplaced_urls_are_settled(spark):
    rows = [("a", "https://docs.google.com/d/1", "pending", None, None), ("b", "https://github.com/x", "pending", {"github": "old", "k": "v"}, ["l"]),
            ("c", "https://me.example", "pending", {}, []), ("d", "", "pending", {}, []), ("e", "", "pending", {"k": "v"}, []),
            ("f", "https://www.linkedin.com/in/f", "pending", {}, []), ("g", "https://me.example", "enriched", {}, []), ("h", None, "pending", {}, [])]
    people = spark.createDataFrame(rows, "id string, linkedin_url string, enrichment_status string, fetched_content map<string,string>, enrichment_log array<string>")
    people = people.selectExpr("*", "'' AS resume_url", "'' AS website_url", "array('z') AS other_links")
    fetched = spark.createDataFrame([("https://github.com/x", "github", "new"), ("https://github.com/x", "later", "other"), ("https://docs.google.com/d/1", "doc", "")],
                                    "url string, source string, body string")
    got = {r.id: r for r in upkeep.settle_misplaced(people, fetched).collect()}
    assert {k: r.enrichment_status for k, r in got.items()} == {
        "a": "skipped", "b": "enriched", "c": "skipped", "d": "skipped", "e": "enriched", "f": "pending", "g": "enriched", "h": "skipped"}
    assert got["a"].resume_url == "https://docs.google.com/d/1" and got["c"].website_url == "https://me.example" and got["b"].other_links == ["z", "https://github.com/x"]
    assert got["b"].fetched_content == {"github": "new", "k": "v"} and got["b"].linkedin_url == ""
    assert got["b"].enrichment_log == ["l", "Non-LinkedIn URL fetched as github: https://github.com/x", "Enriched from non-LinkedIn URL content"]
    assert got["g"].linkedin_url == "https://me.example" and got["f"].enrichment_log == []


def test_side_results_of_the_resolver(spark):
    people = spark.createDataFrame([("p", "Ann Bole", "ann@acme.com", "", ""), ("q", "Ann Bole", "ann@acme.com", "https://www.linkedin.com/in/x", "")],
                                   "id string, name string, email string, linkedin_url string, organization string")
    results = spark.createDataFrame(
        [(p, i, u, t, None) for p in "pq" for i, (u, t) in enumerate([(" https://acme.com/a ", "x"), ("https://z.example/", "Ann and Bole"), ("https://z.example/", "x"), ("", "Ann Bole"), (None, None)])],
        "profile_id string, pos long, url string, title string, description string")
    got = evidence.resolver_side_evidence(results, evidence.profile_signals(people), people).collect()
    assert [(r.profile_id, r.url, r.anchors, r.snippet) for r in sorted(got, key=lambda r: r.pos)] == [
        ("p", "https://acme.com/a", ["email_match"], ""), ("p", "https://z.example/", ["name_match"], "")]
