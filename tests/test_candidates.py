"""Context, requests and keywords of candidate search against plain Python."""

from rollcall.operators import candidates


def test_requests_are_written_once_per_profile(spark):
    """The plan stands once in the query, not again for every request that is compared."""
    rows = [("a", "Ana Sol", "ana@acme.org", "acme", "Lead"), ("b", "Bo", "", "", ""), ("c", " ", "x@y.org", "", "")]
    context = candidates.extract_context(spark.createDataFrame(rows, ["id", "name", "email", "organization", "title"]))
    found = candidates.search_requests(context)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("linkedin OR researchgate") == 1
    got = {(r.profile_id, r.step): (r.label, r.query, r.fallback) for r in found.collect()}
    # Steps 8 and 9 have the text of step 3.
    assert set(got) == {("a", step) for step in (1, 2, 3, 6, 10, 11, 12, 13)}
    assert got["a", 3] == ("name+org", '"Ana Sol" "acme" site:linkedin.com/in', False) and got["a", 12][2]


def test_keywords_are_counted_where_the_text_is(spark):
    """Commonest terms, the earlier first among equals; words are neither shuffled nor sorted by a comparing lambda."""
    body = "alpha beta the and alpha beta gamma delta gamma delta alpha beta the and the and zeta1 épsilon omega"
    rows = [(1, "bio", body), (1, "other", "omega omega omega and the long tail"), (2, "bio", "too short"), (4, "bio", " ".join(candidates.KEYWORD_STOPWORDS)), (None, "bio", "the and the and the and the and"), (3, "bio", None)]
    found = candidates.keywords(spark.createDataFrame(rows, "profile_id long, field_name string, body string"), 20)
    assert "comparator" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "lambda left" not in plan
    assert "MapInArrow" in plan
    got = {r.profile_id: r.content_keywords for r in found.collect()}
    assert got == {
        1: ["alpha beta", "omega omega", "the and", "omega and", "beta the", "and the", "alpha", "omega", "gamma", "delta"],
        None: ["the and", "and the"]}


def test_points_are_compiled(spark):
    """The list of points is no argument of a lambda function, where Spark would interpret it."""
    people = spark.createDataFrame([("a", "Ana Sol", "ana@acme.org", "acme", "Lead")], ["id", "name", "email", "organization", "title"])
    rows = [("a", 1, "https://www.linkedin.com/in/ana-sol", "Ana Sol | acme", "at acme", "exact"), ("a", 2, "https://www.linkedin.com/in/x", "Nobody", "", "")]
    found = spark.createDataFrame(rows, ["profile_id", "pos", "url", "title", "description", "evidence_type"])
    scored = candidates.score_candidates(found, candidates.extract_context(people))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "array(CASE WHEN (evidence_type" in plan and "filter(array(CASE WHEN (evidence_type" not in plan
    got = {r.pos: (r.score, r.reasons, r.n_signals) for r in scored.collect()}
    assert got[1][1][:4] == ["email-evidence(+20)", "first-in-title(+2)", "last-in-title(+3)", "org-exact(+6)"] and got[1][0] > 31
    assert got[2] == (0, [], 0)
