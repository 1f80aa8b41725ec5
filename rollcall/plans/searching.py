"""Queries of search results, judging, feedback, ground truth and audit."""

from pyspark.sql import functions as F

from rollcall.functions import replies
from rollcall.operators import attempts, audit, dedup, feedback, ranking, rerun, truth
from rollcall.plans.deduplication import PERSON_ID
from rollcall.plans.normalising import _AUDIT, DOMAIN_SQL, PERSONAL
from rollcall.plans.registry import query
from rollcall.plans.resolving import _ANSWERS
from rollcall.sources import store

_EXCLUDED = "ex AS (SELECT DISTINCT search_id, profile_id FROM feedback WHERE rating = 'strong_no')"


def _people(src):
    return dedup.with_person_id(src("people"))


# --- results ---------------------------------------------------------------------------------
@query("ranked_scores", "SELECT search_id, profile_id, score, name FROM scores JOIN people ON id = profile_id")
def ranked_scores(src):
    return ranking.rank(src("scores"), src("people")).select("search_id", "profile_id", "score", "name")


_RESULTS = f"""WITH {_EXCLUDED},
j AS (SELECT s.search_id, s.profile_id, s.score, coalesce(p.name, 'Unknown') AS name, coalesce(p.email, '') AS email, coalesce(p.linkedin_url, '') AS linkedin_url, coalesce({PERSON_ID}, 'row:' || s.profile_id) AS person FROM scores s LEFT JOIN people p ON p.id = s.profile_id
  WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.search_id = s.search_id AND ex.profile_id = s.profile_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY search_id, person ORDER BY score DESC, profile_id) AS rn, count(*) OVER (PARTITION BY search_id, person) AS dataset_rows FROM j),
res AS (SELECT search_id, profile_id, name, score, email, linkedin_url, cast(dataset_rows AS bigint) AS dataset_rows FROM r WHERE rn = 1)"""


def _results(src):
    return ranking.results(src("scores"), _people(src), feedback.exclusions(src("feedback")))


@query("search_results", _RESULTS + " SELECT * FROM res")
def search_results(src):
    return _results(src)


@query("excluded_counts", f"WITH {_EXCLUDED} SELECT s.search_id, cast(count(*) AS bigint) AS excluded_count FROM scores s JOIN ex ON ex.search_id = s.search_id AND ex.profile_id = s.profile_id GROUP BY 1")
def excluded_counts(src):
    return ranking.excluded_counts(src("scores"), feedback.exclusions(src("feedback")))


@query("results_page", _RESULTS + """ SELECT * , trim(concat_ws(' ', CASE WHEN linkedin_url LIKE '%linkedin.com%' THEN linkedin_url END, concat('https://home.example.net/', lower(email)))) AS extra_links FROM (SELECT * FROM res WHERE search_id = 's1' ORDER BY score DESC, profile_id LIMIT 50)""")
def results_page(src):
    texts = src("people").select(F.col("id").alias("profile_id"), F.concat(
        F.lit("see www.google.com/x, "), F.lit("https://home.example.net/"), F.lower("email"), F.lit(" now")).alias("raw_text"))
    return ranking.top_page(_results(src), texts, "s1").withColumn("extra_links", F.array_join("extra_links", " "))


@query("feedback_subjects", """
SELECT f.event_id, f.search_id, f.profile_id, f.rating, p.name, s.score FROM feedback f LEFT JOIN people p ON p.id = f.profile_id LEFT JOIN scores s ON s.search_id = f.search_id AND s.profile_id = f.profile_id""")
def feedback_subjects(src):
    return ranking.with_subject(src("feedback"), src("people"), src("scores")).select(
        "event_id", "search_id", "profile_id", "rating", "name", "score")


@query("stale_scores", "SELECT search_id, profile_id, 'h1' AS prompt_hash FROM scores WHERE prompt_hash <> 'h1'")
def stale_scores(src):
    wanted = src("scores").select("search_id", "profile_id", F.lit("h1").alias("prompt_hash"))
    return ranking.stale_scores(wanted, src("scores"))


@query("score_drift", """
SELECT a.search_id, cast(count(*) AS bigint) AS n, cast(count(*) FILTER (a.score <> b.s) AS bigint) AS changed, round(avg((a.score - b.s)::double), 6) AS mean_shift, round(avg(abs(a.score - b.s)::double), 6) AS mean_abs_shift
FROM scores a JOIN (SELECT search_id, profile_id, CASE WHEN prompt_hash = 'h0' THEN score ELSE score * 2 % 101 END AS s FROM scores) b ON a.search_id = b.search_id AND a.profile_id = b.profile_id GROUP BY 1""")
def score_drift(src):
    before = src("scores").withColumn("score", F.when(F.col("prompt_hash") == "h0", F.col("score")).otherwise(F.col("score") * 2 % 101))
    return ranking.score_drift(before, src("scores"))


_CARDS = "cd AS (SELECT p.id AS profile_id, p.name, coalesce(d.text, '') AS profile_card FROM people p LEFT JOIN documents d ON d.doc_id = p.source_row)"


def _cards(src):
    docs = src("documents").select(F.col("doc_id").alias("source_row"), F.col("text").alias("profile_card"))
    return src("people").join(docs, "source_row", "left").select(
        F.col("id").alias("profile_id"), "name", F.coalesce("profile_card", F.lit("")).alias("profile_card"))


@query("term_scores", f"""WITH {_CARDS}
SELECT 's0' AS search_id, profile_id, cast(floor(100 * len(list_intersect(['and', 'data', 'le', 'the'], list_distinct(regexp_extract_all(lower(profile_card), '([\\p{{L}}\\p{{N}}_]+)', 1)))) / 4.0) AS int) AS score FROM cd""")
def term_scores(src):
    searches = src("region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("search_id"), F.lit("The data AND le the").alias("query"))
    return ranking.term_scores(_cards(src), searches, "s0")


@query("custom_scores", f"""WITH {_CARDS} SELECT 's0' AS search_id, profile_id, cast(least(100, length(profile_card) // 10) AS int) AS score FROM cd""")
def custom_scores(src):
    return ranking.custom_scores(_cards(src), lambda texts: (texts.str.len() // 10).tolist(), "s0")


@query("judge_batch_texts", f"""WITH {_CARDS},
b AS (SELECT *, left(md5(profile_id), 2) AS batch_group, floor((row_number() OVER (PARTITION BY left(md5(profile_id), 2) ORDER BY profile_id) - 1) / 40)::int AS batch_no FROM cd)
SELECT batch_group, batch_no, cast(count(*) AS bigint) AS n_profiles, md5(string_agg(concat('ID:', profile_id, chr(10), coalesce(nullif(name, ''), 'Unknown'), chr(10), left(profile_card, 3000), chr(10), '---'), chr(10) ORDER BY profile_id)) AS text_md5 FROM b GROUP BY ALL""")
def judge_batch_texts(src):
    return ranking.judge_batches(_cards(src)).select("batch_group", "batch_no", "n_profiles", F.md5("user_text").alias("text_md5"))


@query("judge_system_texts", """
WITH e AS (SELECT c_nationkey AS sid, c_custkey, concat('Score ', c_custkey % 97, ': ', c_name, ' — ', left(repeat(c_mktsegment, 40), 200), ' — "', c_mktsegment, '"') AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 97 DESC, c_custkey) AS r FROM customer)
SELECT n_nationkey AS search_id, concat('QUERY: people of ', n_name, chr(10), chr(10), 'CONTEXT:', chr(10), 'region ', n_regionkey, chr(10), chr(10), 'GLOBAL RULES:', chr(10), '- be fair', chr(10), chr(10), 'SEARCH RULES:', chr(10), '- live in ', n_name, chr(10), '- speak up', chr(10),
 (SELECT concat(chr(10), 'CALIBRATION EXAMPLES:', chr(10), string_agg(t, chr(10) ORDER BY r)) FROM e WHERE sid = n_nationkey)) AS system_text FROM nation""")
def judge_system_texts(src):
    lit = F.lit
    searches = src("nation").select(
        F.col("n_nationkey").alias("search_id"), F.concat(lit("people of "), "n_name").alias("query"), F.concat(lit("region "), F.col("n_regionkey").cast("string")).alias("clarification_context"),
        F.array(lit("be fair")).alias("global_rules"), F.array(F.concat(lit("live in "), "n_name"), lit("speak up")).alias("search_rules"), F.array().cast("array<string>").alias("corrections"))
    exemplars = src("customer").select(
        F.col("c_nationkey").alias("search_id"), F.col("c_custkey").alias("place"), F.col("c_name").alias("profile_name"), F.repeat("c_mktsegment", 40).alias("profile_summary"),
        (F.col("c_custkey") % 97).alias("score"), F.col("c_mktsegment").alias("reason"))
    return ranking.judge_prompts(searches, exemplars)


@query("arbiter_question_texts", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS r FROM candidates),
b AS (SELECT profile_id, string_agg(concat('  [', r - 1, '] ', url, chr(10), '    title: ', title, chr(10), '    snippet: ', left(description, 500), chr(10), '    heuristic_score: ', length(title), chr(10), '    reasons: ', evidence_type), chr(10) ORDER BY r) AS c FROM t WHERE r <= 5 GROUP BY 1)
SELECT profile_id, concat('PROFILE:', chr(10), '  name: ', name, chr(10), '  email: ', email, chr(10), '  organization: ', organization, chr(10), '  title: ', title, chr(10), chr(10), 'CANDIDATES:', chr(10), c) AS user_text FROM people JOIN b ON profile_id = id""")
def arbiter_question_texts(src):
    from rollcall.operators.keyed import top_per_key

    pools = top_per_key(src("candidates"), ["profile_id"], [F.asc("pos")], 5).withColumns(
        {"score": F.length("title"), "reasons": F.array("evidence_type")})
    return ranking.arbiter_prompts(src("people"), pools)


@query("prompt_hashes", """
SELECT n_nationkey AS search_id, left(sha256(concat('people of ', n_name, chr(31), 'region ', n_regionkey, chr(31), r)), 16) AS prompt_hash FROM nation JOIN (SELECT s_nationkey, string_agg(s_name, chr(30) ORDER BY s_suppkey) AS r FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def prompt_hashes(src):
    searches = src("nation").select(F.col("n_nationkey").alias("search_id"), F.concat(F.lit("people of "), "n_name").alias("query"),
                                    F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("clarification_context"))
    rules = src("supplier").select(F.col("s_nationkey").alias("search_id"), F.col("s_suppkey").alias("rule_no"), F.col("s_name").alias("rule"))
    hashed = ranking.with_prompt_hash(searches, rules)
    return hashed.join(rules.select("search_id").distinct(), "search_id", "left_semi").select("search_id", "prompt_hash")


@query("applicable_rules", "SELECT p_partkey AS rule_id, p_name AS rule FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def applicable_rules(src):
    rules = src("part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("rule"))
    return ranking.applicable_rules(rules, src("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("rule_id")))


@query("transcript_contexts", """
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN concat('Search clarification summary:', chr(10), 'about ', conv_id) ELSE string_agg(concat(CASE role WHEN 'assistant' THEN 'Q: ' ELSE 'A: ' END, text), chr(10) ORDER BY turn) END AS context FROM conversations GROUP BY conv_id""")
def transcript_contexts(src):
    conv = F.col("conv_id")
    summaries = src("conversations").select("conv_id").distinct().select(
        "conv_id", F.when(conv % 3 == 0, F.concat(F.lit("about "), conv.cast("string"))).otherwise("").alias("summary"))
    return ranking.transcript_context(src("conversations"), summaries)


_JR = """jr AS (SELECT batch_id, CASE batch_id % 5 WHEN 0 THEN regexp_extract(text, '(\\[.*\\])', 1, 's') ELSE text END AS j FROM judge_responses WHERE batch_id % 5 < 4),
je AS (SELECT batch_id, json_extract_string(e, '$.id') AS profile_id, coalesce(try_cast(json_extract_string(e, '$.s') AS double), try_cast(json_extract_string(e, '$.score') AS double), 0) AS s, coalesce(json_extract_string(e, '$.r'), json_extract_string(e, '$.reasoning'), '') AS reasoning FROM (SELECT batch_id, unnest(json_extract(j, '$[*]')) AS e FROM jr WHERE j LIKE '[%')
 UNION ALL SELECT batch_id, k, coalesce(try_cast(json_extract_string(v, '$') AS double), try_cast(json_extract_string(v, '$.s') AS double)), coalesce(json_extract_string(v, '$.r'), '') FROM (SELECT batch_id, unnest(json_keys(j)) AS k, unnest(json_extract(j, '$.*')) AS v FROM jr WHERE j LIKE '{%')),
js AS (SELECT batch_id, profile_id, cast(greatest(0, least(100, trunc(s))) AS int) AS score, reasoning FROM je)"""


@query("judge_answers", f"WITH {_JR} SELECT * FROM js")
def judge_answers(src):
    return replies.parse_judge(src("judge_responses"))


@query("judge_scores", f"WITH {_JR} SELECT r.batch_id, r.profile_id, coalesce(js.score, 0) AS score, coalesce(js.reasoning, '') AS reasoning FROM judge_responses r LEFT JOIN js ON js.batch_id = r.batch_id AND js.profile_id = r.profile_id")
def judge_scores(src):
    return replies.judge_scores(src("judge_responses").select("batch_id", "profile_id"), src("judge_responses"))


@query("arbiter_answers", f"""WITH {_ANSWERS}
SELECT a.profile_id, CASE WHEN wi BETWEEN 0 AND 4 THEN wi END AS winner_index, CASE WHEN b IN ('high', 'medium', 'low') THEN b ELSE 'low' END AS answer_confidence, CASE WHEN js IS NULL THEN concat('arbiter_parse_error: ', left(text, 100)) ELSE coalesce(nullif(rs, ''), 'no-reason') END AS answer_reason, js IS NULL AS error
FROM (SELECT r.profile_id, text, wi, js, lower(json_extract_string(js, '$.confidence')) AS b, json_extract_string(js, '$.reason') AS rs FROM (SELECT profile_id, text, CASE WHEN contains(text, '{{') THEN regexp_extract(text, '(\\{{.*\\}})', 1, 's') END AS js FROM arbiter_responses) r JOIN ans ON ans.profile_id = r.profile_id) a""")
def arbiter_answers(src):
    return replies.parse_arbiter(src("arbiter_responses"), 5)


# --- vectors and quality --------------------------------------------------------------------------
@query("vector_search", """
WITH m AS (SELECT list(a ORDER BY i) AS q FROM (SELECT i, avg(x::double) AS a FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i)),
s AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::double), q) AS c FROM embeddings, m)
SELECT 'mean' AS query, vec_id, round(c, 6) AS cosine, cast(row_number() OVER (ORDER BY c DESC, vec_id) AS int) AS rank FROM s ORDER BY c DESC, vec_id LIMIT 20""")
def vector_search(src):
    vectors = src("embeddings")
    return ranking.vector_search(vectors, {"mean": ranking.mean_vector(vectors)}, 20).withColumn("cosine", F.round("cosine", 6))


_JUDGED = "jd AS (SELECT search_id AS query_id, profile_id AS item_id, score, CASE WHEN enrichment_status = 'enriched' THEN 2 WHEN enrichment_status = 'pending' THEN 1 ELSE 0 END AS relevance FROM scores JOIN people ON id = profile_id)"


def _judged(src):
    people = src("people").select(F.col("id").alias("profile_id"), "enrichment_status")
    relevance = F.when(F.col("enrichment_status") == "enriched", 2).when(F.col("enrichment_status") == "pending", 1).otherwise(0)
    return src("scores").join(people, "profile_id").select(F.col("search_id").alias("query_id"), F.col("profile_id").alias("item_id"), "score", relevance.alias("relevance"))


@query("ranking_quality", f"""WITH {_JUDGED},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, item_id) AS ip FROM jd)
SELECT query_id, round(count(*) FILTER (p <= 10 AND relevance > 0) / 10.0::double, 6) AS precision_at_k, round(coalesce(1.0::double / min(p) FILTER (relevance > 0), 0), 6) AS reciprocal_rank,
 round(sum(CASE WHEN p <= 10 THEN (pow(2, relevance) - 1) / log2(p + 1) ELSE 0 END) / sum(CASE WHEN ip <= 10 THEN (pow(2, relevance) - 1) / log2(ip + 1) ELSE 0 END), 6) AS ndcg_at_k FROM r GROUP BY query_id""")
def ranking_quality(src):
    return ranking.ranking_quality(_judged(src))


@query("bad_in_top", f"""WITH {_JUDGED} SELECT query_id, cast(count(*) FILTER (relevance <= 0) AS bigint) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS p FROM jd) WHERE p <= 10 GROUP BY 1""")
def bad_in_top(src):
    return ranking.bad_in_top(_judged(src))


# --- feedback ----------------------------------------------------------------------------------------
@query("latest_opinions", """
SELECT search_id, profile_id, score, reason, created_at FROM (SELECT *, CASE rating WHEN 'strong_yes' THEN 95 ELSE 5 END AS score, row_number() OVER (PARTITION BY search_id, profile_id ORDER BY created_at DESC, event_id DESC) AS rn FROM
 (SELECT * REPLACE (coalesce(nullif(trim(reason), ''), CASE rating WHEN 'strong_yes' THEN 'Marked as excellent' ELSE 'Rejected without reason' END) AS reason) FROM feedback WHERE rating <> 'yes')) WHERE rn = 1""")
def latest_opinions(src):
    return feedback.latest_opinions(src("feedback"))


@query("offers_of_known", """
SELECT event_id, search_id, profile_id, CASE rating WHEN 'strong_yes' THEN 95 ELSE 5 END AS score, p.name AS profile_name, left(concat('Works at ', p.organization), 300) AS profile_summary FROM feedback f JOIN people p ON p.id = f.profile_id WHERE rating <> 'yes'""")
def offers_of_known(src):
    people = src("people").withColumn("raw_text", F.concat(F.lit("Works at "), F.col("organization")))
    return feedback.offers_of_known(src("feedback"), people).select("event_id", "search_id", "profile_id", "score", "profile_name", "profile_summary")


@query("prompt_corrections", """
SELECT search_id, 'CORRECTION: ' || reason AS correction, min(event_id) AS place FROM feedback WHERE trim(reason) <> '' AND rating <> 'yes' AND profile_id IN (SELECT id FROM people) GROUP BY ALL""")
def prompt_corrections(src):
    events = src("feedback").withColumns({
        "reasoning_correction": F.when(F.col("rating") != "yes", "edited").otherwise(""),
        "prompt_correction": F.when(F.trim("reason") != "", F.concat(F.lit("CORRECTION: "), "reason")).otherwise("")})
    return feedback.prompt_corrections(events, src("people"))


@query("rerun_scores", """
WITH s AS (SELECT 's' || r_regionkey AS search_id, 'd' || r_regionkey % 4 AS dataset_id, 'inc lead ' || lower(r_name) AS query FROM region),
r AS (SELECT 's' || n_regionkey AS search_id, n_nationkey AS no, n_name AS rule FROM nation),
a AS (SELECT 's' || s_nationkey % 2 AS search_id, min(s_suppkey) AS no, 'prefer ' || s_nationkey AS rule FROM supplier GROUP BY ALL),
l AS (SELECT search_id, no, CASE WHEN rule = (SELECT max(n_name) FROM nation WHERE n_regionkey = 2) THEN 'new ' || rule ELSE rule END AS rule FROM r
  UNION ALL SELECT search_id, (SELECT max(no) FROM r WHERE r.search_id = a.search_id) + no, rule FROM a),
x AS (SELECT 's3' AS search_id, string_agg('p' || c_custkey || chr(29) || '95' || chr(29) || 'o', chr(30) ORDER BY c_custkey) AS e FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10)),
h AS (SELECT s.*, left(sha256(concat(query, chr(31), (SELECT string_agg(rule, chr(30) ORDER BY no) FROM r WHERE r.search_id = s.search_id), chr(31), '')), 16) AS old,
 left(sha256(concat(query, chr(31), (SELECT string_agg(rule, chr(30) ORDER BY no) FROM l WHERE l.search_id = s.search_id), chr(31), coalesce(e, ''))), 16) AS new FROM s LEFT JOIN x ON x.search_id = s.search_id)
SELECT h.search_id, p.id AS profile_id, h.new AS prompt_hash, CASE WHEN h.new = h.old THEN p.source_row % 101 ELSE 100 * len(list_filter(string_split(query, ' '), lambda w: list_contains(regexp_extract_all(lower(organization || ' ' || title), '[a-z]+'), w))) // 3 END::INTEGER AS score
FROM h JOIN people p ON p.dataset_id = h.dataset_id""")
def rerun_scores(src):
    sid = lambda c: F.concat(F.lit("s"), c.cast("string")).alias("search_id")
    key = F.col("r_regionkey")
    searches = src("region").select(sid(key), F.concat(F.lit("d"), (key % 4).cast("string")).alias("dataset_id"), F.concat(F.lit("inc lead "), F.lower("r_name")).alias("query"))
    rules = src("nation").select(sid(F.col("n_regionkey")), F.col("n_nationkey").alias("rule_no"), F.col("n_name").alias("rule"))
    none = src("region").where("false").select(sid(key), key.alias("place"), F.lit("").alias("profile_id"), F.lit(0).alias("score"), F.lit("").alias("reason"))
    last = rules.where("search_id = 's2'").agg(F.max("rule").alias("old_rule"))
    proposal = rerun.Proposal(
        src("supplier").select(sid(F.col("s_nationkey") % 2), F.col("s_suppkey").alias("add_no"), F.concat(F.lit("prefer "), F.col("s_nationkey").cast("string")).alias("rule")),
        last.select(F.lit("s2").alias("search_id"), F.lit(1).alias("swap_no"), "old_rule", F.concat(F.lit("new "), "old_rule").alias("new_rule")),
        none, src("customer").select(F.lit("s3").alias("search_id"), F.col("c_custkey").alias("place"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("profile_id"), F.lit(95).alias("score"), F.lit("o").alias("reason")))
    people = src("people").withColumn("profile_card", F.concat_ws(" ", "organization", "title"))
    before = ranking.with_prompt_hash(searches, rules, none).join(people, "dataset_id").select(
        "search_id", F.col("id").alias("profile_id"), "prompt_hash", (F.col("source_row") % 101).cast("int").alias("score"))
    return rerun.rerun(searches, rules, none, proposal, people, before).scores


@query("search_exclusions", "SELECT DISTINCT search_id, profile_id FROM feedback WHERE rating = 'strong_no'")
def search_exclusions(src):
    return feedback.exclusions(src("feedback"))


@query("edited_exclusions", """
SELECT DISTINCT search_id, profile_id FROM feedback WHERE rating IN ('strong_no', 'no') AND (search_id, profile_id) NOT IN (SELECT (search_id, profile_id) FROM feedback WHERE rating = 'strong_yes')""")
def edited_exclusions(src):
    rated = lambda r: src("feedback").where(F.col("rating") == r).select("search_id", "profile_id")
    return store.edit_set(rated("strong_no").distinct(), rated("no"), rated("strong_yes"))


@query("feedback_counts", "SELECT concat('s', n_nationkey) AS search_id, cast(coalesce(n, 0) AS bigint) AS n_feedback FROM nation LEFT JOIN (SELECT search_id, count(*) AS n FROM feedback GROUP BY 1) f ON f.search_id = concat('s', n_nationkey)")
def feedback_counts(src):
    searches = src("nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("search_id"))
    return feedback.feedback_counts(searches, src("feedback"))


@query("search_table", """
SELECT concat('s', n_nationkey) AS search_id, cast(coalesce(s.n, 0) AS bigint) AS n_scores, cast(coalesce(f.n, 0) AS bigint) AS n_feedback, last_feedback FROM nation LEFT JOIN (SELECT search_id, count(*) AS n FROM scores GROUP BY 1) s ON s.search_id = concat('s', n_nationkey)
LEFT JOIN (SELECT search_id, count(*) AS n, max(created_at) AS last_feedback FROM feedback GROUP BY 1) f ON f.search_id = concat('s', n_nationkey)""")
def search_table(src):
    searches = src("nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("search_id"))
    return store.search_rows(searches, src("scores"), src("feedback"))


@query("edited_rules", """
WITH r AS (SELECT c_nationkey AS search_id, c_custkey AS rule_no, c_mktsegment || c_custkey % 50 AS rule FROM customer), a AS (SELECT s_nationkey AS search_id, s_suppkey AS add_no, CASE WHEN s_acctbal < 0 THEN '' ELSE 'BUILDING' || s_suppkey % 50 END AS rule FROM supplier),
f AS (SELECT search_id, rule, min(add_no) AS add_no FROM a WHERE rule <> '' AND (search_id, rule) NOT IN (SELECT (search_id, rule) FROM r) GROUP BY ALL),
l AS (SELECT * FROM r UNION ALL SELECT f.search_id, coalesce((SELECT max(rule_no) FROM r WHERE r.search_id = f.search_id), 0) + add_no, rule FROM f)
SELECT search_id, rule_no, CASE WHEN rule LIKE 'MACHINERY%' AND (search_id, rule) IN (SELECT (search_id, rule) FROM r) THEN 'new ' || rule ELSE rule END AS rule FROM l""")
def edited_rules(src):
    rules = src("customer").select(F.col("c_nationkey").alias("search_id"), F.col("c_custkey").alias("rule_no"),
                                   F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("rule"))
    added = src("supplier").select(F.col("s_nationkey").alias("search_id"), F.col("s_suppkey").alias("add_no"), F.when(F.col("s_acctbal") < 0, "").otherwise(
        F.concat(F.lit("BUILDING"), (F.col("s_suppkey") % 50).cast("string"))).alias("rule"))
    replaced = rules.where(F.startswith("rule", F.lit("MACHINERY"))).select(
        "search_id", F.col("rule_no").alias("swap_no"), F.col("rule").alias("old_rule"), F.concat(F.lit("new "), "rule").alias("new_rule"))
    return feedback.edit_rules(rules, added, replaced)


@query("edited_exemplars", """
WITH e AS (SELECT s_nationkey AS search_id, s_suppkey AS place, s_name AS profile_id FROM supplier WHERE s_acctbal > 0), o AS (SELECT c_nationkey AS search_id, c_custkey AS place, c_name AS profile_id FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY place, profile_id) AS r FROM o) SELECT search_id, place, profile_id FROM e UNION ALL SELECT search_id, place, profile_id FROM f WHERE r <= 10 - (SELECT count(*) FROM e WHERE e.search_id = f.search_id)""")
def edited_exemplars(src):
    listed = src("supplier").select(F.col("s_nationkey").alias("search_id"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("profile_id"), F.lit(5).alias("score"), F.lit("r").alias("reason"))
    removed = src("supplier").where("s_acctbal <= 0").select(F.col("s_nationkey").alias("search_id"), F.col("s_name").alias("profile_id"))
    offered = src("customer").select(F.col("c_nationkey").alias("search_id"), F.col("c_custkey").alias("place"), F.col("c_name").alias("profile_id"), F.lit(95).alias("score"), F.lit("o").alias("reason"))
    return feedback.edit_exemplars(listed, removed, offered).select("search_id", "place", "profile_id")


# --- ground truth -------------------------------------------------------------------------------------
_NORM = "CASE WHEN contains({u}, 'linkedin.com') THEN split_part(rtrim(lower(trim({u})), '/'), '?', 1) ELSE rtrim(lower(trim({u})), '/') END"


@query("ground_truth_metrics", f"""
WITH j AS (SELECT unnest(['linkedin', 'website', 'twitter']) AS field, unnest([{', '.join(_NORM.format(u=f'p.{f}_url') for f in truth.FIELDS)}]) AS s, unnest([{', '.join(_NORM.format(u=f'g.true_{f}_url') for f in truth.FIELDS)}]) AS t FROM people p JOIN ground_truth g ON g.profile_id = p.id),
c AS (SELECT field, count(*) AS n, count(*) FILTER (s <> '' AND t <> '' AND s = t) AS tp, count(*) FILTER (s <> '' AND NOT (t <> '' AND s = t)) AS fp, count(*) FILTER (t <> '' AND NOT (s <> '' AND s = t)) AS fn, count(*) FILTER (s = '' AND t = '') AS tn, count(*) FILTER (s <> '' AND t <> '' AND s <> t) AS wrong_person FROM j GROUP BY field),
d AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::double / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::double / (tp + fn) END AS r FROM c)
SELECT field, n, tp, fp, fn, tn, wrong_person, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 3) AS f1 FROM d""")
def ground_truth_metrics(src):
    return truth.score_fields(src("people"), src("ground_truth"))


@query("hidden_accuracy", """
SELECT count(*) AS n, count(*) FILTER ((linkedin_url = '' AND website_url = '' AND twitter_url = '') = true_is_hidden) AS correct, round(count(*) FILTER ((linkedin_url = '' AND website_url = '' AND twitter_url = '') = true_is_hidden) / count(*)::double, 3) AS hidden_accuracy FROM people JOIN ground_truth ON profile_id = id""")
def hidden_accuracy(src):
    return truth.hidden_accuracy(src("people"), src("ground_truth"))


@query("label_sample", f"""
WITH c AS (SELECT *, md5('7:' || id) AS draw, concat(CASE WHEN email = '' THEN 'no_email' WHEN dom IN {PERSONAL} THEN 'personal' WHEN dom LIKE '%.edu' THEN 'edu' WHEN dom LIKE '%.gov' THEN 'gov' ELSE 'corp' END,
  CASE WHEN trim(organization) = '' THEN '+noorg' ELSE '+org' END) AS cohort FROM (SELECT *, {DOMAIN_SQL.format(e='email')} AS dom FROM people)),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY draw, id) > (SELECT greatest(1, 60 // count(DISTINCT cohort)) FROM c) AS more FROM c)
SELECT id AS profile_id, name AS uploaded_name, email, organization, title, linkedin_url AS current_linkedin_url, enrichment_status AS current_enrichment_status,
 '' AS true_linkedin_url, '' AS true_website_url, '' AS true_twitter_url, '' AS true_is_hidden, '' AS notes FROM r ORDER BY more, draw, id LIMIT 60""")
def label_sample(src):
    from rollcall.sources.sinks import label_sheet

    return label_sheet(truth.stratified_sample(src("people"), 60, seed=7))


@query("audit_sample", "SELECT id FROM people WHERE enrichment_status = 'enriched' ORDER BY md5('3:' || id), id LIMIT 100")
def audit_sample(src):
    return audit.audit_sample(src("people"), 100, seed=3).select("id")


# --- audit ------------------------------------------------------------------------------------------------
def _pairs(src):
    people = src("people").where("enrichment_status = 'enriched'").select(F.col("id").alias("profile_id"), F.col("name").alias("uploaded_name"))
    return people.join(src("vendor").select("profile_id", "full_name"), "profile_id")


def _suspects(src):
    return audit.audit_pairs(_pairs(src), audit.alias_table(src.spark))


_LAST = "coalesce(list_filter({t}, lambda x: x NOT IN ('jr','sr','ii','iii','iv','phd','ph','md','dr','esq'))[-1], {t}[-1], '')"
# Names of the views have distinct tokens, so the greedy overlap equals plain set overlap.
_SUSPECTS = f"""ap AS (SELECT p.id AS profile_id, trim(p.name) AS uploaded_name, trim(v.full_name) AS enriched_name, list_filter(string_split({_AUDIT.format(c='p.name')}, ' '), lambda x: x <> '') AS a, list_filter(string_split({_AUDIT.format(c='v.full_name')}, ' '), lambda x: x <> '') AS b FROM people p JOIN vendor v ON v.profile_id = p.id WHERE enrichment_status = 'enriched'),
aq AS (SELECT *, len(list_filter(a, lambda x: len(list_filter(b, lambda y: x = y OR (length(x) = 1 AND starts_with(y, x)) OR (length(y) = 1 AND starts_with(x, y)))) > 0)) AS m, {_LAST.format(t='a')} AS a_last, {_LAST.format(t='b')} AS b_last FROM ap WHERE len(a) > 0 AND len(b) > 0),
ar AS (SELECT *, m::double / (len(a) + len(b) - m) AS ov, len(a) = 1 AS one, NOT (a_last = b_last OR (length(a_last) = 1 AND starts_with(b_last, a_last)) OR (length(b_last) = 1 AND starts_with(a_last, b_last))) AS df FROM aq),
sp AS (SELECT profile_id, uploaded_name, enriched_name, round(ov, 3) AS overlap, a_last, b_last, array_to_string(list_filter([CASE WHEN df THEN CASE WHEN one THEN 'single_token_uploaded_name' ELSE 'different_last_name' END END, CASE WHEN ov = 0 THEN 'no_shared_tokens' WHEN ov < 0.5 AND NOT one THEN 'token_overlap_below_50pct' END], lambda x: x IS NOT NULL), ',') AS flags FROM ar)"""


@query("wrong_person_suspects", f"WITH {_SUSPECTS} SELECT * FROM sp WHERE flags <> ''")
def wrong_person_suspects(src):
    return _suspects(src).withColumn("flags", F.array_join("flags", ","))


@query("audit_summary", f"""WITH {_SUSPECTS}, n AS (SELECT count(*) AS sample_size FROM people WHERE enrichment_status = 'enriched'),
c AS (SELECT count(*) AS suspects, count(*) FILTER (NOT contains(flags, 'single_token')) AS strong_suspects, count(*) FILTER (contains(flags, 'single_token')) AS weak_suspects FROM sp WHERE flags <> '')
SELECT sample_size, suspects, strong_suspects, weak_suspects, round(strong_suspects / sample_size::double, 4) AS rate_lower_bound, round(suspects / sample_size::double, 4) AS rate_including_weak, strong_suspects AS projected_suspects FROM n, c""")
def audit_summary(src):
    return audit.audit_summary(audit.audit_sample(src("people"), None), _suspects(src))


_SAME = "(lower(trim({a})) <> '' AND lower(trim({a})) = lower(trim({b})))"


def _fix(cur: str, ven: str, own: str) -> str:
    copied = _SAME.format(a=cur, b=ven)
    return f"""CASE WHEN {own} IS NOT NULL AND trim({own}) <> '' AND NOT {_SAME.format(a=own, b=cur)} THEN {{{{'reason': 'restored-from-source', 'v': trim({own})}}}} WHEN {own} IS NOT NULL AND trim({own}) <> '' THEN {{{{'reason': 'matches-source-already', 'v': NULL}}}}
 WHEN {own} IS NOT NULL AND {copied} THEN {{{{'reason': 'source-blank-current-matches-enriched', 'v': CASE WHEN sus THEN '' END}}}} WHEN {own} IS NOT NULL THEN {{{{'reason': 'source-blank-current-differs', 'v': NULL}}}}
 WHEN {copied} AND sus THEN {{{{'reason': 'blanked-suspect-matches-enriched', 'v': ''}}}} WHEN {copied} THEN {{{{'reason': 'nonsuspect-matches-enriched-keep', 'v': NULL}}}} WHEN {cur} = '' AND {ven} <> '' AND sus THEN {{{{'reason': 'already-empty-suspect', 'v': NULL}}}} ELSE {{{{'reason': 'unchanged-differs-from-enriched', 'v': NULL}}}} END""".replace("{{{{", "{{").replace("}}}}", "}}").replace("{{", "{").replace("}}", "}")


_CLEAN = _SUSPECTS + """,
k AS (SELECT lower(trim(email)) AS em, lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS nm, organization AS o, CASE WHEN pos % 3 = 0 THEN '' ELSE concat('T', pos % 4) END AS t, pos FROM known_people),
ke AS (SELECT em, arg_min({'o': trim(o), 't': trim(t)}, pos) AS r FROM k WHERE em <> '' GROUP BY em), kn AS (SELECT nm, arg_min({'o': trim(o), 't': trim(t)}, pos) AS r FROM k WHERE nm <> '' GROUP BY nm),
b AS (SELECT p.*, v.current_company AS vc, v.current_title AS vt, coalesce(ke.r, kn.r) AS r, s.profile_id IS NOT NULL AS sus FROM people p JOIN vendor v ON v.profile_id = p.id LEFT JOIN ke ON ke.em = lower(trim(p.email)) AND p.email <> '' LEFT JOIN kn ON kn.nm = lower(regexp_replace(trim(p.name), '\\s+', ' ', 'g')) AND p.name <> '' LEFT JOIN (SELECT profile_id FROM sp WHERE flags <> '') s ON s.profile_id = p.id),
c AS (SELECT *, """ + _fix("organization", "vc", "r.o") + " AS fo, " + _fix("title", "vt", "r.t") + """ AS ft FROM b),
ch AS (SELECT id, sus AS suspect, organization AS old_organization, title AS old_title, CASE WHEN fo.v <> organization THEN fo.v END AS new_organization, CASE WHEN ft.v <> title THEN ft.v END AS new_title, fo.reason AS organization_reason, ft.reason AS title_reason, nullif(vc, '') AS new_enriched_organization, nullif(vt, '') AS new_enriched_title FROM c)"""


def _changes(src):
    rows = src("known_people").select("pos", "email", "name", F.trim("organization").alias("organization"), F.when(F.col("pos") % 3 == 0, "").otherwise(
        F.concat(F.lit("T"), (F.col("pos") % 4).cast("string"))).alias("title"))
    return audit.clean_up(src("people"), src("vendor"), _suspects(src), rows)


@query("clean_up_changes", f"WITH {_CLEAN} SELECT * FROM ch")
def clean_up_changes(src):
    return _changes(src)


@query("clean_up_counts", f"""WITH {_CLEAN}, t AS (SELECT *, new_organization IS NOT NULL OR new_title IS NOT NULL AS tch, organization_reason = 'restored-from-source' OR title_reason = 'restored-from-source' AS rst FROM ch)
SELECT count(*) AS scanned, count(*) FILTER (suspect AND tch) AS wrong_person_fixed, count(*) FILTER (suspect AND tch AND rst) AS wrong_person_restored_from_source, count(*) FILTER (suspect AND tch AND NOT rst) AS wrong_person_blanked,
 count(*) FILTER (new_enriched_organization IS NOT NULL OR new_enriched_title IS NOT NULL) AS shadow_field_populated, count(*) FILTER (NOT suspect AND tch) AS backfill_cleared_nonsuspect, count(*) FILTER (suspect AND NOT tch) AS skipped_uncertain, count(*) FILTER (NOT suspect AND NOT tch) AS already_clean FROM t""")
def clean_up_counts(src):
    return audit.clean_up_counts(_changes(src))


@query("clean_up_sample", f"""WITH {_CLEAN} SELECT id, old_organization, new_organization, old_title, new_title FROM ch WHERE new_organization IS NOT NULL OR new_title IS NOT NULL ORDER BY id LIMIT 25""")
def clean_up_sample(src):
    return audit.clean_up_sample(_changes(src))


@query("alias_equivalence", """
WITH a AS (SELECT * FROM (VALUES ('bob',0),('rob',0),('robert',0),('ed',1),('ted',1),('edward',1),('ted',2),('theo',2),('theodore',2)) t(n, g)),
nm AS (SELECT c_custkey, ['Bob','Ed','Théo','Zed'][c_custkey % 4 + 1] AS l, ['rob','edward','Theodore','Zed','robert.'][c_custkey % 5 + 1] AS r FROM customer),
k AS (SELECT *, regexp_replace(lower(strip_accents(l)), '[^\\p{L}-]', '', 'g') AS kl, regexp_replace(lower(strip_accents(r)), '[^\\p{L}-]', '', 'g') AS kr FROM nm),
f AS (SELECT x.n, list(DISTINCT y.n) AS fs FROM a x JOIN a y ON x.g = y.g GROUP BY x.n)
SELECT c_custkey, l AS left_name, r AS right_name, len(list_intersect(coalesce(fl.fs, [kl]), coalesce(fr.fs, [kr]))) > 0 AS equivalent FROM k LEFT JOIN f fl ON fl.n = kl LEFT JOIN f fr ON fr.n = kr""")
def alias_equivalence(src):
    groups = [["bob", "rob", "robert"], ["ed", "ted", "edward"], ["ted", "theo", "theodore"]]
    aliases = src.spark.createDataFrame([(n, i) for i, g in enumerate(groups) for n in g], "name STRING, group_id INT")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % n).cast("int"))
    names = src("customer").select("c_custkey", pick(["Bob", "Ed", "Théo", "Zed"], 4).alias("left_name"), pick(["rob", "edward", "Theodore", "Zed", "robert."], 5).alias("right_name"))
    return audit.names_equivalent(names, "left_name", "right_name", aliases)


_TIED = """ca AS (SELECT concat('p', user_id) AS profile_id, event_id AS pos, concat('  [ ', event_id % 25, '] https://www.linkedin.com/in/c', event_id % 200, '/  (first-in-title(+2), slug-name(2)(+4))') AS line FROM events),
cx AS (SELECT profile_id, pos, cast(regexp_extract(line, '\\[\\s*(-?\\d+)\\]', 1) AS int) AS score, rtrim(regexp_extract(line, '(https?://\\S+)', 1), '/') AS url FROM ca)"""


def _candidate_lines(src):
    line = F.concat(F.lit("  [ "), (F.col("event_id") % 25).cast("string"), F.lit("] https://www.linkedin.com/in/c"), (F.col("event_id") % 200).cast("string"),
                    F.lit("/  (first-in-title(+2), slug-name(2)(+4))"))
    return src("events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("profile_id"), F.col("event_id").alias("pos"), line.alias("line"))


@query("logged_candidates", f"WITH {_TIED} SELECT profile_id, pos, score, url, 'first-in-title(+2)|slug-name(2)(+4)' AS reasons FROM cx")
def logged_candidates(src):
    return attempts.tied_candidates(_candidate_lines(src)).withColumn("reasons", F.array_join("reasons", "|"))


_COMPARED = f"""WITH {_TIED}, {_ANSWERS},
ts AS (SELECT profile_id, 3 AS tie_count, 9 AS tie_score FROM (SELECT DISTINCT profile_id FROM log_lines WHERE contains(line, 'candidates tied at score'))),
pl AS (SELECT profile_id, list(url ORDER BY score DESC, pos) AS pool FROM cx GROUP BY 1),
cp AS (SELECT ts.profile_id, ts.tie_count, ts.tie_score, pool[1:5][wi + 1] AS picked_url, CASE WHEN js_null THEN 'errored' WHEN pool[1:5][wi + 1] IS NOT NULL THEN 'picked' ELSE 'abstained' END AS outcome
FROM ts JOIN people p ON p.id = ts.profile_id AND p.enrichment_status = 'skipped' LEFT JOIN pl ON pl.profile_id = ts.profile_id LEFT JOIN (SELECT ans.profile_id, CASE WHEN wi BETWEEN 0 AND 4 THEN wi END AS wi, NOT contains(text, '{{') AS js_null FROM ans JOIN arbiter_responses USING (profile_id)) an ON an.profile_id = ts.profile_id)"""


@query("arbiter_comparison", _COMPARED + " SELECT * FROM cp")
def arbiter_comparison(src):
    return audit.arbiter_comparison(src("people"), attempts.tie_signatures(src("log_lines")), attempts.tied_candidates(_candidate_lines(src)),
                                    replies.parse_arbiter(src("arbiter_responses"), 5))


@query("arbiter_summary", _COMPARED + " SELECT outcome, count(*) AS n FROM cp GROUP BY outcome")
def arbiter_summary(src):
    return audit.arbiter_summary(arbiter_comparison(src))

