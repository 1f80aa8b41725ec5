"""Registered queries against their SQL on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rollcall.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
EVERY = entry.oracle_sql()
# A spread over all families; ROLLCALL_ALL=1 runs every query.
QUICK = [
    "coverage_by_email_type", "cohort_analysis", "cost_summary", "recommendations", "verification_attempts", "replay_sweep",
    "duplicates_combined", "duplicates_by_name", "person_ids", "name_signals", "merged_links", "url_canonical_forms", "page_bios",
    "candidate_scores", "resolved_with_arbiter", "harvested_candidates", "assigned_evidence", "org_site_evidence", "merged_evidence",
    "staged_profiles", "evidence_write_back", "verified_pairs", "parsed_payloads", "settled_candidates", "upserted_people",
    "column_name_types", "profiles_from_rows", "trimmed_logs", "profile_cards", "search_results", "judge_answers",
    "ranking_quality", "ground_truth_metrics", "clean_up_changes", "stream_attempts",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return [normal(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(EVERY) if os.environ.get("ROLLCALL_ALL") else QUICK)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(([normal(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    res = duck.execute(EVERY[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(([normal(r[names.index(c)]) for c in cols] for r in res.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(EVERY) <= set(entry.queries())
