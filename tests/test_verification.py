"""Hand-written expectations for the match verifier; all names are invented."""

import pytest

from rollcall.operators import verification

SCHEMA = ("profile_id STRING, name STRING, organization STRING, linkedin_url_source STRING, country STRING, city STRING, content_text STRING, "
          "url STRING, full_name STRING, companies ARRAY<STRING>, location STRING, context_block STRING")
LONG = "underwater robotics sensors navigation autonomy " * 6 + "marine biology currents harbour lighthouse cartography sextant"


def case(name, full, org="", companies=("",), source="", country="", city="", place="", content="", block="", url="https://www.linkedin.com/in/x9"):
    return ("p", name, org, source, country, city, content, url, full, list(companies), place, block)


CASES = [
    (case("Verona Castell", "Verona Castell"), "accept", "accepted (name=strong"),
    (case("Ines Boulet", "Inès Boulet, MBA"), "accept", "accepted (name=normal"),
    (case("Verona Castell", "Otto Brand"), "reject", "name mismatch"),
    (case("Abo Castell", "Abo Brand"), "reject", "weak name match rejected (short-token-only)"),
    (case("Verona Castell", "Verona Brand"), "reject", "weak name match rejected (last-name-missing)"),
    (case("Verona", "Verona Brand"), "reject", "score_below_threshold"),
    (case("Verona", "Verona Brand", "Globex", ["Globex Corp"]), "accept", "accepted (name=weak, positives=1"),
    (case("Verona Castell", "Verona Castell", "Initech", ["Globex"]), "reject", "soft_penalty_no_positive"),
    (case("Verona Castell", "Verona Castell", "Initech", ["Globex"], country="Norland", place="Oslo, Norland"), "accept", "accepted (name=strong, positives=1, penalties=1"),
    (case("Verona Castell", "Verona Castell", "Stealth startup", ["Globex"]), "accept", "accepted"),
    (case("Ines Boulet", "Ines Boulet", url="https://www.linkedin.com/in/ines-boulet-4/"), "accept", "accepted (name=normal, positives=0"),
    (case("Verona Castell", "Verona Castell", content=LONG, block="robotics sensors navigation and more"), "accept", "accepted (name=strong, positives=1"),
    (case("Verona Castell", "Verona Castell", content=LONG, block="plumbing welding"), "reject", "soft_penalty_no_positive"),
    (case("Verona Castell", "Otto Brand", source="user"), "reject", "user_provided_but_names_disjoint"),
    (case("Verona Castell", "Verona C", source="user"), "accept", "user_provided_linkedin_url_trusted"),
    (case("", "Otto Brand"), "reject", "score_below_threshold"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(f"p{i}",) + row[1:] for i, (row, _, _) in enumerate(CASES)], SCHEMA)
    got = {r.profile_id: r for r in verification.verify_pairs(df).collect()}
    for i, (_, decision, reason) in enumerate(CASES):
        assert got[f"p{i}"].decision == decision, (i, got[f"p{i}"])
        assert got[f"p{i}"].reason.startswith(reason), (i, got[f"p{i}"].reason)


def test_slug_adds_score_but_no_positive(spark):
    df = spark.createDataFrame([case("Ines Boulet", "Ines Boulet", url="https://www.linkedin.com/in/ines-boulet-4/")], SCHEMA)
    row = verification.verify_pairs(df).first()
    assert row.score == 4 and row.anchors_positive == ["name_normal", "slug_match"]


@pytest.mark.parametrize("status,body,outcome", [
    (200, '{"full_name": "A"}', "ok"), (200, "", "empty_body"), (200, "{", "json_parse_error"), (200, '{"error": "x"}', "api_error_field"),
    (404, "", "404_not_found"), (429, "", "429_rate_limited_exhausted"), (502, "", "5xx_persisted"), (402, "no Credits", "out_of_credits"), (418, "", "non_200:418")])
def test_payload_outcomes(spark, status, body, outcome):
    df = spark.createDataFrame([(status, body)], "status INT, body STRING")
    assert df.select(verification.classify_payload(df.status, df.body)).first()[0] == outcome


def test_settling(spark):
    rows = [("a", 1, "u1", "404_not_found", False, ""), ("a", 2, "u2", "ok", True, ""), ("a", 3, "u3", "ok", True, ""),
            ("b", 1, "u1", "empty_body", False, "user"), ("c", 1, "u1", "ok", False, "user"), ("d", 1, "u1", "out_of_credits", False, "")]
    df = spark.createDataFrame(rows, "profile_id STRING, turn INT, url STRING, outcome STRING, verified BOOLEAN, linkedin_url_source STRING")
    got = {r.profile_id: (r.enrichment_status, r.new_linkedin_url, r.calls) for r in verification.settle_candidates(df).collect()}
    assert got == {"a": ("enriched", "u2", 2), "b": ("pending", None, 1), "c": ("failed", None, 1), "d": ("failed", "", 0)}
    assert verification.settle_candidates(df, transient_fails=True).where("profile_id = 'b'").first().enrichment_status == "failed"
