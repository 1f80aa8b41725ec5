"""Queries of the report, cost, cohort and log-replay operators."""

from pyspark.sql import functions as F

from rollcall.operators import attempts, reports
from rollcall.plans.normalising import DOMAIN_SQL, PERSONAL
from rollcall.plans.registry import query

EMAIL_TYPE = f"""CASE WHEN email = '' THEN 'no_email' WHEN NOT contains(email, '@') THEN 'malformed' WHEN {DOMAIN_SQL.format(e='email')} IN {PERSONAL} THEN 'personal' WHEN lower(email) LIKE '%.edu' THEN 'edu'
 WHEN lower(email) LIKE '%.gov' THEN 'gov' WHEN lower(email) LIKE '%.org' THEN 'org' ELSE 'corp' END"""
NAME_BUCKET = r"CASE WHEN trim(name) = '' THEN 'no_name' ELSE CASE len(string_split_regex(trim(name), '\s+')) WHEN 1 THEN 'single_token' WHEN 2 THEN 'two_token' ELSE 'three_plus_token' END END"
_COSTED = f"""lc AS (SELECT profile_id, count(*) FILTER (contains(line, 'Search (')) AS s, count(*) FILTER (contains(line, 'Trying LinkedIn:')) AS v FROM log_lines GROUP BY profile_id),
costed AS (SELECT p.*, {EMAIL_TYPE} AS email_type, coalesce(s, 0) AS searches, coalesce(v, 0) AS vendor_calls, coalesce(s, 0) * 0.006::double + coalesce(v, 0) * 0.0168::double AS cost FROM people p LEFT JOIN lc ON lc.profile_id = p.id)"""
_AXES = f"""axed AS (SELECT costed.*, a.axis, CASE a.axis WHEN 'overall' THEN 'all' WHEN 'email_type' THEN email_type WHEN 'org_presence' THEN CASE WHEN trim(organization) = '' THEN 'no_org' ELSE 'org_present' END
 WHEN 'name_length' THEN {NAME_BUCKET} WHEN 'email_x_org' THEN concat(email_type, '×', CASE WHEN trim(organization) = '' THEN 'no-org' ELSE 'has-org' END)
 ELSE CASE WHEN email_type IN ('no_email', 'malformed') THEN 'no-email' ELSE concat(CASE WHEN email_type = 'personal' THEN 'name+personal-email' ELSE 'name+corp-email' END, CASE WHEN trim(organization) = '' THEN '+no-org' ELSE '+org' END) END END AS bucket
 FROM costed, (SELECT unnest(['overall','email_type','org_presence','name_length','email_x_org','input_quality']) AS axis) a)"""
_STATUSES = ", ".join(f"cast(count(*) FILTER (enrichment_status = '{s}') AS bigint) AS {s}" for s in ("pending", "enriched", "failed", "skipped"))


@query("coverage_by_email_type", f"""
WITH {_COSTED}
SELECT email_type AS bucket, cast(count(*) AS bigint) AS total, {_STATUSES}, cast(sum(searches) AS bigint) AS searches, cast(sum(vendor_calls) AS bigint) AS vendor_calls,
 round_even(100.0::double * count(*) FILTER (enrichment_status = 'enriched') / count(*), 1) AS enriched_pct, round(sum(searches) * 0.006::double + sum(vendor_calls) * 0.0168::double, 4) AS cost_usd,
 round((sum(searches) * 0.006::double + sum(vendor_calls) * 0.0168::double) / count(*), 4) AS cost_per_profile
FROM costed GROUP BY email_type""")
def coverage_by_email_type(src):
    return reports.coverage_by_axis_with_cost(src("people"), src("log_lines"))


@query("status_report", """
SELECT enrichment_status AS status, cast(count(*) AS bigint) AS n, round_even(100.0::double * count(*) / (SELECT count(*) FROM people), 1) AS pct FROM people GROUP BY 1""")
def status_report(src):
    return reports.status_report(src("people"))


@query("markdown_report", """
SELECT 0 AS place, '| status | n |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL
SELECT 2, concat('| ', enrichment_status, ' | ', count(*), ' |') FROM people GROUP BY enrichment_status""")
def markdown_report(src):
    return reports.markdown_lines(reports.status_report(src("people")).select("status", "n"))


@query("version_report", """
SELECT coalesce(nullif(enrichment_version, ''), '(none)') AS version, cast(count(*) AS bigint) AS n FROM people GROUP BY 1""")
def version_report(src):
    return reports.version_report(src("people"))


@query("cohort_status", f"""
WITH {_COSTED}, {_AXES}
SELECT axis, bucket, cast(count(*) AS bigint) AS total, {_STATUSES}, round_even(100.0::double * count(*) FILTER (enrichment_status = 'enriched') / count(*), 1) AS enriched_pct
FROM axed WHERE axis <> 'overall' GROUP BY axis, bucket""")
def cohort_status(src):
    return reports.cohort_status(src("people"))


@query("source_presence", """
WITH t AS (SELECT unnest(['linkedin','twitter','website','card']) AS source, unnest([linkedin_url <> '', twitter_url <> '', website_url <> '', organization <> '']) AS present, enrichment_status = 'enriched' AS done FROM people)
SELECT source, cast(count(*) FILTER (present) AS bigint) AS among_all, cast(count(*) FILTER (present AND done) AS bigint) AS among_enriched,
 round_even(100.0::double * count(*) FILTER (present AND done) / count(*) FILTER (done), 1) AS among_enriched_pct FROM t GROUP BY source""")
def source_presence(src):
    return reports.source_presence(src("people"), {
        "linkedin": F.col("linkedin_url") != "", "twitter": F.col("twitter_url") != "",
        "website": F.col("website_url") != "", "card": F.col("organization") != ""})


@query("log_pattern_counts", """
SELECT event, cast(count(*) AS bigint) AS n FROM log_lines JOIN (SELECT unnest(['search_query','trying_linkedin','verify_accepted','verify_rejected','weak_match_rejected','org_mismatch','org_mismatch_generic','no_linkedin_found','verification_failed','out_of_credits','out_of_credits_alt','enrichlayer_error']) AS event,
 unnest(['Search (','Trying LinkedIn','Verify result: ACCEPTED','Verify result: REJECTED','WEAK-MATCH REJECTED','Verify org: MISMATCH','MISMATCH','No LinkedIn profile found','verification failed','Out of API credits','OUT_OF_CREDITS','LinkedIn enrichment failed']) AS needle) ON contains(line, needle) GROUP BY event""")
def log_pattern_counts(src):
    return reports.log_pattern_counts(src("log_lines"))


@query("profile_costs", f"""
WITH {_COSTED} SELECT id, cast(searches AS bigint) AS searches, cast(vendor_calls AS bigint) AS vendor_calls, round(cost, 6) AS cost FROM costed""")
def profile_costs(src):
    return reports.log_costs(src("people"), src("log_lines")).select("id", "searches", "vendor_calls", F.round("cost", 6).alias("cost"))


@query("cost_summary", f"""
WITH {_COSTED}, r AS (SELECT round(cost, 9) AS cost, row_number() OVER (ORDER BY cost) - 1 AS i, count(*) OVER () AS n FROM costed)
SELECT cast(count(*) AS bigint) AS profiles, cast(sum(searches) AS bigint) AS searches, cast(sum(vendor_calls) AS bigint) AS vendor_calls,
 round(sum(searches) * 0.006::double + sum(vendor_calls) * 0.0168::double, 4) AS total_usd, round((sum(searches) * 0.006::double + sum(vendor_calls) * 0.0168::double) / count(*), 4) AS mean_usd,
 round(median(round(cost, 9)), 4) AS p50_usd, (SELECT round(cost, 4) FROM r WHERE i = round_even(0.95::double * (n - 1), 0)) AS p95_usd FROM costed""")
def cost_summary(src):
    return reports.cost_summary(reports.log_costs(src("people"), src("log_lines")))


_FAIL_CASE = " ".join(f"WHEN contains(line, '{n}') THEN '{b}'" for n, b in reports.FAILURE_PATTERNS)


@query("failure_reasons", f"""
SELECT DISTINCT profile_id, CASE {_FAIL_CASE} END AS reason FROM log_lines WHERE CASE {_FAIL_CASE} END IS NOT NULL""")
def failure_reasons(src):
    return reports.failure_reasons(src("log_lines"))


@query("top_failure_reasons", f"""
WITH {_COSTED}, {_AXES}, fr AS (SELECT DISTINCT profile_id, CASE {_FAIL_CASE} END AS reason FROM log_lines),
c AS (SELECT axis, bucket, reason, count(*) AS n FROM axed JOIN fr ON fr.profile_id = axed.id WHERE reason IS NOT NULL AND enrichment_status IN ('failed', 'skipped') GROUP BY ALL)
SELECT axis, bucket, reason, cast(n AS bigint) AS n, cast(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY axis, bucket ORDER BY n DESC, reason) AS rank FROM c) WHERE rank <= 5""")
def top_failure_reasons(src):
    return reports.top_failure_reasons(src("people"), src("log_lines"))


_ANALYSIS = f"""WITH {_COSTED}, {_AXES}, an AS (SELECT axis, bucket, count(*) AS n, count(*) FILTER (enrichment_status = 'enriched') AS enriched,
 round_even(100.0::double * count(*) FILTER (enrichment_status = 'enriched') / count(*), 1) AS rate FROM axed GROUP BY axis, bucket)"""


@query("cohort_analysis", f"""
WITH {_COSTED}, {_AXES}
SELECT axis, bucket, cast(count(*) AS bigint) AS n, {_STATUSES}, cast(0 AS bigint) AS wrong_person_n, cast(sum(searches) AS bigint) AS searches, cast(sum(vendor_calls) AS bigint) AS vendor_calls, round(median(round(cost, 9)), 4) AS median_cost,
 {", ".join(f"round_even(100.0::double * count(*) FILTER (enrichment_status = '{s}') / count(*), 1) AS {s}_pct" for s in ("pending", "enriched", "failed", "skipped"))},
 cast(0 AS double) AS wrong_person_pct, round(sum(searches) * 0.006::double + sum(vendor_calls) * 0.0168::double, 4) AS total_cost,
 round((sum(searches) * 0.006::double + sum(vendor_calls) * 0.0168::double) / count(*), 4) AS mean_cost FROM axed GROUP BY axis, bucket""")
def cohort_analysis(src):
    return reports.cohort_analysis(reports.log_costs(src("people"), src("log_lines")))


@query("report_integrity", _ANALYSIS + """
SELECT axis, cast(sum(n) AS bigint) AS sum_of_buckets, sum(n) = (SELECT count(*) FROM people) AS matches_total FROM an WHERE axis <> 'overall' GROUP BY axis""")
def report_integrity(src):
    return reports.integrity(reports.cohort_analysis(reports.log_costs(src("people"), src("log_lines"))))


@query("recommendations", _ANALYSIS + """
SELECT * FROM (SELECT CASE WHEN axis = 'email_type' AND n >= 5 AND bucket = 'edu' AND rate < 50 THEN 'academic-coverage-low' WHEN axis = 'email_type' AND n >= 5 AND bucket = 'gov' AND rate >= 50 THEN 'public-sector-pages-pay'
 WHEN axis = 'email_type' AND n >= 5 AND bucket = 'personal' AND rate < 50 THEN 'personal-email-hardest' WHEN axis = 'email_type' AND n >= 5 AND bucket = 'corp' THEN 'corporate-baseline'
 WHEN axis = 'org_presence' AND bucket = 'no_org' AND n >= 5 AND rate < 20 THEN 'no-organisation-weak' END AS rule, axis, bucket, cast(n AS bigint) AS n, rate FROM an) WHERE rule IS NOT NULL
UNION ALL (SELECT 'hardest-input', axis, bucket, cast(n AS bigint), rate FROM an WHERE axis = 'input_quality' AND n >= 5 ORDER BY rate, bucket LIMIT 1)""")
def recommendations(src):
    return reports.recommendations(reports.cohort_analysis(reports.log_costs(src("people"), src("log_lines"))))


_VALID = "(regexp_matches(linkedin_url, '/in/|/company/') AND NOT regexp_matches(linkedin_url, '/public-profile/settings|/feed/|/pub/dir/'))"
_STATS = f"""SELECT cast(count(*) AS bigint) AS total, cast(count(*) FILTER ({_VALID}) AS bigint) AS have_url, cast(count(*) FILTER (email <> '' AND NOT {_VALID}) AS bigint) AS email_only,
 cast(count(*) FILTER (email = '' AND NOT {_VALID}) AS bigint) AS no_signal, cast(count(*) FILTER (enrichment_status = 'enriched') AS bigint) AS already_enriched FROM people"""


@query("upload_statistics", _STATS)
def upload_statistics(src):
    return reports.upload_statistics(src("people"))


@query("run_cost_estimate", f"""
WITH s AS ({_STATS}), t AS (SELECT email_only AS lookups, greatest(0, have_url - already_enriched) + cast(floor(email_only * 0.8::double) AS bigint) AS vendor_calls FROM s)
SELECT lookups, vendor_calls, round(lookups * 0.005::double, 6) AS lookup_usd, round(vendor_calls * 0.01::double, 6) AS vendor_usd, round(round(lookups * 0.005::double, 6) + round(vendor_calls * 0.01::double, 6), 6) AS total_usd,
 CASE WHEN lookups * 0.005::double + vendor_calls * 0.01::double > 100 THEN 'large' WHEN lookups * 0.005::double + vendor_calls * 0.01::double > 10 THEN 'significant' ELSE '' END AS warning FROM t""")
def run_cost_estimate(src):
    return reports.cost_estimate(reports.upload_statistics(src("people")))


@query("batch_run_statistics", f"""
WITH {_COSTED} SELECT enrichment_status AS state, cast(count(*) AS bigint) AS n, round(sum(cost), 4) AS cost FROM costed GROUP BY 1""")
def batch_run_statistics(src):
    costed = reports.log_costs(src("people"), src("log_lines"))
    return reports.run_statistics(costed.withColumnRenamed("enrichment_status", "state"))


_MARKED = r"""ml AS (SELECT *, nullif(rtrim(regexp_extract(line, 'Trying LinkedIn:\s*(\S+)', 1), '/'), '') AS url, nullif(regexp_extract(line, 'Verify name: MATCH.*?strength=(\w+)', 1), '') AS strength,
  CASE WHEN contains(line, 'Verify result: ACCEPTED') THEN 'accepted' WHEN contains(line, 'Verify result: REJECTED') THEN 'rejected' WHEN contains(line, 'API returned no data') THEN 'no_data' END AS closing FROM log_lines),
nl AS (SELECT *, sum((url IS NOT NULL)::int) OVER w AS attempt_no, sum((closing IS NOT NULL)::int) OVER w - (closing IS NOT NULL)::int AS cb FROM ml WINDOW w AS (PARTITION BY profile_id ORDER BY pos)),
fl AS (SELECT *, max(CASE WHEN url IS NOT NULL THEN cb END) OVER (PARTITION BY profile_id, attempt_no) AS oc, max(attempt_no) OVER (PARTITION BY profile_id) AS newest FROM nl WHERE attempt_no > 0),
att AS (SELECT profile_id, attempt_no, min(pos) AS pos, max(url) AS url, coalesce(arg_max(strength, pos) FILTER (strength IS NOT NULL), 'none') AS name_strength,
  bool_or(contains(line, 'Verify name: MISMATCH')) AS name_mismatch, bool_or(contains(line, 'WEAK-MATCH REJECTED')) AS name_weak_rejected, bool_or(contains(line, 'Verify org: MATCH')) AS org_match, bool_or(contains(line, 'Verify org: MISMATCH')) AS org_mismatch,
  bool_or(contains(line, 'Verify location: MATCH')) AS location_match, bool_or(contains(line, 'Verify location: MISMATCH')) AS location_mismatch, bool_or(contains(line, 'Verify content relevance: MATCH')) AS content_match, bool_or(contains(line, 'Verify content relevance: WEAK')) AS content_weak,
  max(closing) AS closing, coalesce(max(line) FILTER (closing IS NOT NULL), '') AS cl, max(newest) AS newest FROM fl WHERE cb = oc GROUP BY profile_id, attempt_no),
attempts AS (SELECT *, coalesce(closing, CASE WHEN name_mismatch OR name_weak_rejected THEN 'rejected' WHEN attempt_no = newest THEN 'no_data' ELSE 'unknown' END) AS stored_decision,
  coalesce(try_cast(nullif(regexp_extract(cl, 'score=(-?\d+)', 1), '') AS int), 0) AS raw_score, coalesce(try_cast(nullif(regexp_extract(cl, 'checks=(\d+)', 1), '') AS int), 0) AS raw_checks,
  CASE closing WHEN 'accepted' THEN NOT regexp_matches(cl, 'name=|positives=') WHEN 'rejected' THEN NOT regexp_matches(cl, 'penalties=|corroborating|weak name match') ELSE false END AS legacy_log_format FROM att)"""
_ATTEMPT_COLS = """profile_id, cast(attempt_no AS bigint) AS attempt_no, pos, url, name_strength, name_mismatch, name_weak_rejected, org_match, org_mismatch, location_match, location_mismatch, content_match, content_weak,
 stored_decision, raw_score, raw_checks, legacy_log_format"""
# A small slice length makes the two-level running sum cross slice borders in the check.
_CHUNK = 1024


@query("verification_attempts", f"WITH {_MARKED} SELECT {_ATTEMPT_COLS} FROM attempts")
def verification_attempts(src):
    return attempts.parse_attempts(src("log_lines"), _CHUNK)


_CONFIGS = {"default": {}, "strict": {"require_anchors": 1, "baseline_threshold": 3}, "lenient": {
    "reject_on_weak_name_no_positive": False, "reject_on_penalty_no_positive": False, "baseline_threshold": 1,
    "honor_weak_match_hard_reject": False}}
_REPLAY = _MARKED + """,
cfg AS (SELECT * FROM (VALUES ('default', 2, 0, true, true, true), ('strict', 3, 1, true, true, true), ('lenient', 1, 0, false, false, false)) t(config, thr, req, rw, rp, hw)),
sc AS (SELECT a.*, c.*, CASE name_strength WHEN 'strong' THEN 3 WHEN 'normal' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END + CASE WHEN org_match THEN 3 WHEN org_mismatch THEN -1 ELSE 0 END
  + CASE WHEN location_match THEN 2 WHEN location_mismatch THEN -1 ELSE 0 END + CASE WHEN content_match THEN 2 WHEN content_weak THEN -1 ELSE 0 END AS score,
  org_match::int + location_match::int + content_match::int AS positives, (NOT org_match AND org_mismatch)::int + (NOT location_match AND location_mismatch)::int + (NOT content_match AND content_weak)::int AS penalties
  FROM attempts a, cfg c WHERE stored_decision <> 'no_data'),
rp AS (SELECT *, CASE WHEN name_mismatch THEN 'name-mismatch' WHEN hw AND name_weak_rejected THEN 'weak-match-reject' WHEN name_strength = 'none' THEN 'no-name-signal' WHEN score < thr THEN concat('score<', thr)
  WHEN req > 0 AND positives < req THEN concat('<', req, '-positive-anchors') WHEN rw AND name_strength = 'weak' AND positives = 0 THEN 'weak-name-no-positive' WHEN rp AND penalties > 0 AND positives = 0 THEN 'penalty-no-positive' ELSE 'accepted' END AS reason FROM sc),
fp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, config ORDER BY CASE WHEN reason = 'accepted' THEN 0 ELSE 1 END, attempt_no) AS rn FROM rp) WHERE rn = 1),
ag AS (SELECT profile_id, count(*) AS attempts, bool_or(legacy_log_format) AS legacy FROM attempts GROUP BY profile_id),
cm AS (SELECT p.id AS profile_id, cfg.config, CASE WHEN enrichment_status = 'enriched' THEN 'accepted' WHEN enrichment_status = 'failed' AND coalesce(ag.attempts, 0) > 0 THEN 'rejected' WHEN enrichment_status = 'skipped' THEN 'skipped' ELSE 'no_attempt' END AS stored_decision,
  CASE WHEN fp.reason IS NULL THEN 'no_attempt' WHEN fp.reason = 'accepted' THEN 'accepted' ELSE 'rejected' END AS replay_decision, coalesce(ag.legacy, false) AS legacy
  FROM people p CROSS JOIN cfg LEFT JOIN fp ON fp.profile_id = p.id AND fp.config = cfg.config LEFT JOIN ag ON ag.profile_id = p.id),
cmp AS (SELECT *, stored_decision IN ('accepted','rejected') AND replay_decision IN ('accepted','rejected') AND stored_decision <> replay_decision AS flipped FROM cm)"""


def _compared(src, configs=None):
    return attempts.compare_replay(src("people"), attempts.parse_attempts(src("log_lines"), _CHUNK), configs)


@query("replayed_attempts", f"""WITH {_REPLAY}
SELECT profile_id, config, cast(attempt_no AS bigint) AS attempt_no, url, cast(score AS int) AS score, cast(positives AS int) AS positives, cast(penalties AS int) AS penalties, reason, reason = 'accepted' AS accepted FROM rp""")
def replayed_attempts(src):
    return attempts.replay_attempts(attempts.parse_attempts(src("log_lines"), _CHUNK), _CONFIGS)


@query("replayed_profiles", f"""WITH {_REPLAY}
SELECT profile_id, config, CASE WHEN reason = 'accepted' THEN 'accepted' ELSE 'rejected' END AS replay_decision, url, cast(score AS int) AS score, reason FROM fp""")
def replayed_profiles(src):
    return attempts.replay_profiles(attempts.parse_attempts(src("log_lines"), _CHUNK), _CONFIGS)


@query("replay_sweep", f"""WITH {_REPLAY}
SELECT config, cast(count(*) AS bigint) AS total, cast(count(*) FILTER (replay_decision = 'accepted') AS bigint) AS would_accept, cast(count(*) FILTER (replay_decision = 'rejected') AS bigint) AS would_reject,
 cast(count(*) FILTER (replay_decision = 'no_attempt') AS bigint) AS uncompared, cast(count(*) FILTER (flipped) AS bigint) AS flips, true AS sum_check_ok FROM cmp GROUP BY config""")
def replay_sweep(src):
    return attempts.replay_summary(_compared(src, _CONFIGS))


@query("replay_confusion", f"""WITH {_REPLAY}
SELECT config, stored_decision, replay_decision, cast(count(*) AS bigint) AS n FROM cmp WHERE config = 'default' GROUP BY ALL""")
def replay_confusion(src):
    return attempts.replay_confusion(_compared(src))


@query("stored_decisions", f"""WITH {_MARKED}, ag AS (SELECT profile_id, count(*) AS n, bool_or(legacy_log_format) AS legacy, arg_min(url, attempt_no) FILTER (stored_decision = 'accepted') AS su FROM attempts GROUP BY profile_id)
SELECT id AS profile_id, CASE WHEN enrichment_status = 'enriched' THEN 'accepted' WHEN enrichment_status = 'failed' AND coalesce(n, 0) > 0 THEN 'rejected' WHEN enrichment_status = 'skipped' THEN 'skipped' ELSE 'no_attempt' END AS stored_decision,
 cast(coalesce(n, 0) AS bigint) AS attempts, coalesce(legacy, false) AS legacy, coalesce(su, '') AS stored_url FROM people LEFT JOIN ag ON ag.profile_id = id""")
def stored_decisions(src):
    return attempts.stored_decisions(src("people"), attempts.parse_attempts(src("log_lines"), _CHUNK))


@query("replay_roundtrip", f"""WITH {_REPLAY},
r AS (SELECT config, count(*) FILTER (replay_decision <> 'no_attempt') AS compared, count(*) FILTER (flipped) AS mismatches, count(*) FILTER (replay_decision <> 'no_attempt' AND stored_decision IN ('accepted','rejected') AND NOT legacy) AS cc,
 count(*) FILTER (replay_decision <> 'no_attempt' AND stored_decision IN ('accepted','rejected') AND NOT legacy AND NOT flipped) AS mc, count(*) FILTER (flipped AND legacy) AS lf FROM cmp WHERE config = 'default' GROUP BY config)
SELECT config, cast(compared AS bigint) AS compared, cast(mismatches AS bigint) AS mismatches, cast(cc AS bigint) AS compared_current, cast(mc AS bigint) AS matches_current, cast(lf AS bigint) AS legacy_flips_ignored,
 CASE WHEN compared = 0 THEN 1.0 ELSE round((compared - mismatches)::double / compared, 4) END AS reproducibility_rate, CASE WHEN cc = 0 THEN 1.0 ELSE round(mc::double / cc, 4) END AS reproducibility_rate_current FROM r""")
def replay_roundtrip(src):
    return attempts.roundtrip(_compared(src))


@query("log_tie_signatures", r"""
SELECT profile_id, cast(regexp_extract(l, '(\d+)\s+candidates tied', 1) AS int) AS tie_count, cast(regexp_extract(l, 'tied at score\s+(-?\d+)', 1) AS int) AS tie_score
FROM (SELECT profile_id, arg_min(line, pos) AS l FROM log_lines WHERE regexp_matches(line, '\d+\s+candidates tied at score\s+-?\d+') GROUP BY profile_id)""")
def log_tie_signatures(src):
    return attempts.tie_signatures(src("log_lines"))
