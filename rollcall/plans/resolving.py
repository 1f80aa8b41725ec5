"""Queries of candidate search, scoring, choice and captured evidence."""

from pyspark.sql import functions as F

from rollcall.functions import replies
from rollcall.operators import candidates
from rollcall.plans.normalising import BROKERS, DOMAIN_SQL, PERSONAL
from rollcall.plans.registry import query

STOPWORDS = "(" + ",".join(f"'{w}'" for w in candidates.KEYWORD_STOPWORDS) + ")"
WORDS3 = r"list_filter(regexp_extract_all(lower({c}), '([\p{{L}}\p{{N}}_]+)', 1), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))"
_KW = f"""tk AS (SELECT profile_id, {WORDS3.format(c='body')} AS t FROM notes WHERE length(body) > 20),
bg AS (SELECT profile_id, 0 AS kind, t[i] || ' ' || t[i + 1] AS term, i FROM (SELECT profile_id, t, unnest(range(1, len(t))) AS i FROM tk)),
wd AS (SELECT profile_id, 1 AS kind, term, i FROM (SELECT profile_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM (SELECT profile_id, list_filter(t, lambda x: length(x) >= 5) AS w FROM tk))),
ct AS (SELECT profile_id, kind, term, count(*) AS n, min(i) AS fp FROM (SELECT * FROM bg UNION ALL SELECT * FROM wd) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY profile_id, kind ORDER BY n DESC, fp) AS r FROM ct),
kp AS (SELECT *, row_number() OVER (PARTITION BY profile_id, kind ORDER BY r) AS place FROM rk WHERE r <= CASE kind WHEN 0 THEN 10 ELSE 20 END
       AND len(list_filter(string_split(term, ' '), lambda x: x NOT IN {STOPWORDS})) > 0)"""


@query("content_keywords", f"""WITH {_KW}
SELECT profile_id, string_agg(term, '|' ORDER BY kind, place) AS keywords FROM kp WHERE place <= 3 GROUP BY profile_id""")
def content_keywords(src):
    return candidates.keywords(src("notes")).select("profile_id", F.array_join("content_keywords", "|").alias("keywords"))


def _with_metadata(people):
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    return people.withColumn("metadata", F.array(
        entry("Region code", F.col("dataset_id")), entry("Company Name", F.lit("Alternative Works Ltd")), entry("Job role", F.lit(" ")),
        entry("Role (current)", F.lit("Analyst of things")), entry("Country", F.col("country")), entry("nearest_city", F.concat(F.lit("city "), F.col("dataset_id")))))


_CTX = f"""ctx AS (SELECT id AS profile_id, name, email, string_split_regex(trim(name), '\\s+')[1] AS first, CASE WHEN len(string_split_regex(trim(name), '\\s+')) > 1 THEN string_split_regex(trim(name), '\\s+')[-1] ELSE '' END AS last,
 coalesce(nullif(organization, ''), 'Alternative Works Ltd') AS org, coalesce(nullif(title, ''), 'Analyst of things') AS title, country, concat('city ', dataset_id) AS city,
 CASE WHEN contains(email, '@') AND split_part(email, '@', 2) NOT IN {PERSONAL} THEN split_part(split_part(email, '@', 2), '.', 1) ELSE '' END AS email_domain FROM people WHERE trim(name) <> '')"""


@query("search_context", f"""WITH {_CTX} SELECT *, email_domain AS email_company FROM ctx""")
def search_context(src):
    return candidates.extract_context(_with_metadata(src("people"))).drop("content_keywords")


_REQ = _CTX + f""",
q AS (SELECT c.*, concat('"', first, ' ', last, '"') AS who, split_part(email, '@', 1) AS loc, split_part(org, ' ', 1) AS simple, {DOMAIN_SQL.format(e='email')} AS dom FROM ctx c),
rq AS (SELECT profile_id, unnest([
 CASE WHEN email <> '' THEN {{'step': 1, 'label': 'email-exact', 'query': concat('"', email, '"')}} END, CASE WHEN email <> '' THEN {{'step': 2, 'label': 'email-username', 'query': concat('"', loc, '" linkedin OR researchgate')}} END,
 {{'step': 3, 'label': 'name+org', 'query': concat(who, ' "', org, '" site:linkedin.com/in')}}, CASE WHEN length(simple) > 3 AND lower(simple) <> lower(org) THEN {{'step': 4, 'label': 'name+org-simple', 'query': concat(who, ' "', simple, '" site:linkedin.com/in')}} END,
 {{'step': 6, 'label': 'name+title', 'query': concat(who, ' "', title, '" site:linkedin.com/in')}}, {{'step': 7, 'label': 'name+location', 'query': concat(who, ' ', city, ' site:linkedin.com/in')}},
 CASE WHEN email_domain <> '' THEN {{'step': 8, 'label': 'name+email-domain', 'query': concat(who, ' "', email_domain, '" site:linkedin.com/in')}} END,
 CASE WHEN email_domain <> '' AND last <> '' THEN {{'step': 10, 'label': 'org-website', 'query': concat('site:', dom, ' ', who)}} END,
 {{'step': 11, 'label': 'name+org-broad', 'query': concat(who, ' "', org, '" linkedin')}}, CASE WHEN last <> '' THEN {{'step': 12, 'label': 'broad', 'query': concat(who, ' linkedin')}} END,
 CASE WHEN email <> '' AND last <> '' THEN {{'step': 13, 'label': 'slug-email', 'query': concat('site:linkedin.com/in/', lower(loc))}} END]) AS r FROM q)"""


@query("search_requests", f"""WITH {_REQ} SELECT profile_id, cast(r.step AS int) AS step, r.label AS label, r.query AS query, r.step = 12 AS fallback FROM rq WHERE r IS NOT NULL""")
def search_requests(src):
    return candidates.search_requests(candidates.extract_context(_with_metadata(src("people"))))


_PU = r"'https?://(?:\w+\.)?linkedin\.com/in/[\w-]+/?'"
_ORDER = "list_position(['email-exact','email-username','name+org','name+org-simple','name+keywords','name+title','name+location','name+email-domain','org-website','name+org-broad','name+kw-broad','name+domain-broad','broad','slug-email'], label)"
_HARVEST = f"""w AS (SELECT r.*, {_ORDER} AS lo, regexp_matches(url, '^https?://(\\w+\\.)?linkedin\\.com/in/') AS li, rtrim(regexp_extract(description, {_PU}), '/') AS snip, p.dom,
  label IN ('email-exact','org-website','name+org-broad','name+kw-broad','name+domain-broad') AND NOT contains(lower(url), 'linkedin.com') AS fol
  FROM web_results r LEFT JOIN (SELECT id, {DOMAIN_SQL.format(e='email')} AS dom FROM people) p ON p.id = r.profile_id),
hv AS (SELECT profile_id, pos, lo, 0 AS turn, snip AS url, title, description, CASE WHEN label = 'email-exact' THEN 'exact' ELSE '' END AS evidence_type FROM w WHERE li AND label IN ('email-exact','email-username') AND snip <> ''
 UNION ALL SELECT profile_id, pos, lo, 1, url, title, description, CASE WHEN label = 'email-exact' THEN 'exact' ELSE '' END FROM w WHERE li AND label <> 'org-website'
 UNION ALL SELECT profile_id, pos, lo, 2, snip, title, description, 'exact' FROM w WHERE fol AND snip <> ''
 UNION ALL SELECT profile_id, pos, lo, 3, rtrim(u, '/'), concat('via ', lower(regexp_extract(url, '^https?://([^/?#]*)', 1))), title, 'exact' FROM (SELECT w.*, unnest(list_distinct(regexp_extract_all(f.html, {_PU}))) AS u FROM w JOIN followed_pages f ON f.url = w.url
   WHERE fol AND snip = '' AND NOT regexp_matches(lower(w.url), '{BROKERS}') AND ((dom <> '' AND dom NOT IN {PERSONAL} AND contains(lower(w.url), dom)) OR regexp_matches(lower(w.url), '\\.edu|\\.gov|\\.ac\\.uk|\\.org/|\\.org$'))))"""


@query("harvested_candidates", f"""WITH {_HARVEST}
SELECT profile_id, url_key, pos, url, title, description, evidence_type FROM (SELECT *, rtrim(lower(url), '/') AS url_key, row_number() OVER (PARTITION BY profile_id, rtrim(lower(url), '/') ORDER BY lo, turn, pos, url) AS rn FROM hv) WHERE rn = 1""")
def harvested_candidates(src):
    return candidates.harvest_candidates(src("web_results"), src("followed_pages"), src("people"))


_DISTINCT = """dc AS (SELECT profile_id, pos, url, title, description, evidence_type FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, rtrim(lower(url), '/') ORDER BY pos) AS rn FROM candidates) WHERE rn = 1)"""


@query("distinct_candidates", f"WITH {_DISTINCT} SELECT * FROM dc")
def distinct_candidates(src):
    return candidates.distinct_candidates(src("candidates"))


@query("second_source_results", """
WITH f AS (SELECT label AS query, pos AS rank, url FROM (SELECT concat(profile_id, label) AS label, pos, url FROM web_results WHERE label IN ('email-exact', 'name+org'))),
s AS (SELECT concat(profile_id, 'email-exact') AS query, pos AS rank, url FROM web_results WHERE label NOT IN ('email-exact', 'name+org'))
SELECT query, rank, url, 1 AS engine FROM f UNION ALL SELECT s.query, s.rank, s.url, 2 FROM s WHERE (SELECT count(*) FROM f WHERE f.query = s.query) < 3 AND NOT EXISTS (SELECT 1 FROM f WHERE f.query = s.query AND f.url = s.url)""")
def second_source_results(src):
    rows = src("web_results").withColumn("main", F.col("label").isin("email-exact", "name+org"))
    first = rows.where("main").select(F.concat("profile_id", "label").alias("query"), F.col("pos").alias("rank"), "url")
    second = rows.where("NOT main").select(F.concat("profile_id", F.lit("email-exact")).alias("query"), F.col("pos").alias("rank"), "url")
    return candidates.needs_second_source(first, second)


_COMPANY = """vc AS (SELECT profile_id, arg_max(c, pos) AS vco FROM (SELECT profile_id, pos, trim(replace(trim(replace(split_part(title, ' | ', 2), 'Apollo', ''), ' |,-.'), 'ZoomInfo', ''), ' |,-.') AS c FROM web_results
 WHERE label = 'email-exact' AND regexp_matches(lower(url), 'contactout\\.com|rocketreach\\.com|signalhire\\.com|lusha\\.com|apollo\\.io|hunter\\.io|zoominfo\\.com|leadiq\\.com') AND contains(title, ' | ')) WHERE length(c) > 2 GROUP BY profile_id)"""


@query("verified_companies", f"WITH {_COMPANY} SELECT profile_id, vco AS verified_company FROM vc")
def verified_companies(src):
    return candidates.verified_companies(src("web_results"))


_SCORED = f"""{_CTX}, {_COMPANY}, {_DISTINCT},
kw AS (WITH {_KW} SELECT concat('p', profile_id) AS profile_id, list(term ORDER BY kind, place) AS kws FROM kp WHERE place <= 3 GROUP BY profile_id),
j AS (SELECT d.*, lower(first) AS f, lower(last) AS l, lower(org) AS o, lower(c.title) AS ti, lower(city) AS ci, lower(country) AS co, lower(email_domain) AS ed, lower(coalesce(vco, '')) AS v, coalesce(kws, []) AS kws, lower(email) AS em,
  lower(d.title) AS dt, lower(d.title) || ' ' || lower(d.description) AS sh, lower(regexp_extract(rtrim(d.url, '/'), '([^/]*)$', 1)) AS sl FROM dc d JOIN ctx c ON c.profile_id = d.profile_id LEFT JOIN vc ON vc.profile_id = d.profile_id LEFT JOIN kw ON kw.profile_id = d.profile_id),
j2 AS (SELECT *, replace(replace(sl, '-', ''), '_', '') AS sc, len(list_filter(kws, lambda x: contains(sh, x))) AS kh, list_filter(string_split_regex(o, '[\\s&,]+'), lambda x: length(x) > 3) AS ow, list_filter(string_split_regex(v, '[\\s&,]+'), lambda x: length(x) > 2) AS vw,
  list_filter([f, l], lambda x: x <> '') AS np FROM j),
j3 AS (SELECT *, len(list_filter(np, lambda x: list_contains(string_split_regex(sl, '[-_]'), x))) AS h1, len(list_filter(np, lambda x: length(x) >= 4 AND contains(sc, x))) AS h2 FROM j2),
j4 AS (SELECT *, CASE WHEN (CASE WHEN h1 > 0 THEN h1 ELSE h2 END) <= 1 AND f <> '' AND l <> '' AND (contains(sc, f || l[1]) OR contains(sc, f[1] || l)) THEN 2 WHEN h1 > 0 THEN h1 ELSE h2 END AS hits FROM j3),
pt AS (SELECT profile_id, pos, url, title, description, evidence_type, list_filter([
  CASE evidence_type WHEN 'exact' THEN {{'s': 20, 'r': 'email-evidence(+20)'}} WHEN 'proximity' THEN {{'s': 5, 'r': 'email-proximity(+5)'}} END,
  CASE WHEN f <> '' AND contains(dt, f) THEN {{'s': 2, 'r': 'first-in-title(+2)'}} END, CASE WHEN l <> '' AND contains(dt, l) THEN {{'s': 3, 'r': 'last-in-title(+3)'}} END,
  CASE WHEN v <> '' THEN CASE WHEN contains(sh, v) OR (len(vw) > 0 AND len(list_filter(vw, lambda x: contains(sh, x))) = len(vw)) THEN {{'s': 10, 'r': 'email-verified-org(+10)'}} ELSE {{'s': -3, 'r': 'no-verified-org(-3)'}} END
    WHEN o <> '' AND contains(sh, o) THEN {{'s': 6, 'r': 'org-exact(+6)'}} WHEN len(ow) > 0 AND len(list_filter(ow, lambda x: contains(sh, x))) >= len(ow) * 0.6 THEN {{'s': 4, 'r': 'org-words(+4)'}} END,
  CASE WHEN ti <> '' AND contains(sh, ti) THEN {{'s': 4, 'r': 'title-exact(+4)'}} WHEN len(list_filter(string_split(ti, ' '), lambda x: length(x) > 4 AND contains(sh, x))) > 0 THEN {{'s': 2, 'r': 'title-partial(+2)'}} END,
  CASE WHEN ci <> '' AND contains(sh, ci) THEN {{'s': 2, 'r': 'loc-city(+2)'}} WHEN co <> '' AND contains(sh, co) THEN {{'s': 2, 'r': 'loc-country(+2)'}} END,
  CASE WHEN kh >= 2 THEN {{'s': 3, 'r': concat('keywords(', kh, ')(+3)')}} WHEN kh = 1 THEN {{'s': 1, 'r': 'keywords(1)(+1)'}} END, CASE WHEN ed <> '' AND contains(sh, ed) THEN {{'s': 3, 'r': 'email-domain(+3)'}} END,
  CASE WHEN em <> '' AND sc = regexp_replace(split_part(em, '@', 1), '[.-]', '', 'g') THEN {{'s': 8, 'r': 'slug=email(+8)'}} END, CASE WHEN hits > 0 THEN {{'s': hits * 2, 'r': concat('slug-name(', hits, ')(+', hits * 2, ')')}} END,
  CASE WHEN length(l) >= 4 AND NOT contains(sc, l) AND NOT contains(sl, f[1] || l[1]) THEN {{'s': -1, 'r': 'slug-no-last(-1)'}} END], lambda x: x IS NOT NULL) AS p FROM j4),
sd AS (SELECT profile_id, pos, url, title, description, evidence_type, cast(coalesce(list_sum(list_transform(p, lambda x: x.s)), 0) AS int) AS score, list_transform(p, lambda x: x.r) AS reasons,
  len(list_filter(p, lambda x: split_part(x.r, '(', 1) IN ('org-exact','org-words','email-evidence','slug=email','title-exact','loc-city','loc-country'))) AS n_signals FROM pt)"""


def _context(src):
    kw = candidates.keywords(src("notes")).withColumn("profile_id", F.concat(F.lit("p"), F.col("profile_id").cast("string")))
    context = candidates.extract_context(_with_metadata(src("people")), kw)
    return context.join(candidates.verified_companies(src("web_results")), "profile_id", "left")


@query("candidate_scores", f"""WITH {_SCORED}
SELECT profile_id, pos, url, score, array_to_string(reasons, ', ') AS reasons, cast(n_signals AS int) AS n_signals FROM sd""")
def candidate_scores(src):
    scored = candidates.score_candidates(candidates.distinct_candidates(src("candidates")), _context(src))
    return scored.select("profile_id", "pos", "url", "score", F.array_join("reasons", ", ").alias("reasons"), "n_signals")


_PICK = _SCORED + """,
th AS (SELECT ctx.profile_id, 3 + least(3, (org <> '')::int + (title <> '')::int + (city <> '')::int + (country <> '')::int + (email_domain <> '')::int + (kw.kws IS NOT NULL)::int) AS min_score FROM ctx LEFT JOIN kw ON kw.profile_id = ctx.profile_id),
rk2 AS (SELECT *, row_number() OVER w AS r, max(score) OVER (PARTITION BY profile_id) AS mx FROM sd WINDOW w AS (PARTITION BY profile_id ORDER BY score DESC, pos)),
tl AS (SELECT profile_id, list({'url': url, 'score': score, 'reasons': reasons, 'n': n_signals} ORDER BY r) AS all_, list({'url': url, 'score': score, 'reasons': reasons, 'n': n_signals} ORDER BY r) FILTER (score = mx) AS tied, count(*) FILTER (score >= mx - 1) AS n_near, max(mx) AS mx FROM rk2 GROUP BY profile_id),
st AS (SELECT tl.*, th.min_score, len(tied) AS nt, list_max(list_transform(tied, lambda x: x.n)) AS mn FROM tl JOIN th ON th.profile_id = tl.profile_id),
s2 AS (SELECT *, nt > 1 AND tied[1].n > 0 AND coalesce(tied[2].n, 0) = 0 AS lone, list_filter(tied, lambda x: x.n = mn) AS strongest FROM st)"""
_OUT = """SELECT profile_id, outcome, CASE WHEN done THEN ch.url ELSE '' END AS linkedin_url, CASE WHEN NOT done THEN 'none' WHEN ch.score >= 12 THEN 'high' WHEN ch.score >= 7 THEN 'medium' ELSE 'low' END AS confidence,
 mx AS best_score, cast(min_score AS int) AS min_score, cast(nt AS bigint) AS n_tied, cast(n_near AS bigint) AS n_near, CASE WHEN done THEN concat('score=', ch.score, ' (', array_to_string(ch.reasons, ', '), ')') ELSE '' END AS method,
 coalesce(array_to_string(list_transform(CASE WHEN done THEN all_[2:4] WHEN outcome = 'too_weak' THEN [] ELSE tied[1:4] END, lambda x: x.url), ' '), '') AS alternatives
FROM (SELECT *, outcome IN ('selected', 'arbiter_selected') AS done FROM s3)"""


def _flat(resolved):
    return resolved.withColumn("alternatives", F.array_join("alternatives", " "))


@query("resolved_profiles", f"""WITH {_PICK},
s3 AS (SELECT *, CASE WHEN mx < min_score THEN 'too_weak' WHEN nt > 3 AND NOT lone AND len(strongest) > 1 THEN 'ambiguous' ELSE 'selected' END AS outcome, CASE WHEN nt > 1 AND NOT lone AND len(strongest) = 1 THEN strongest[1] ELSE all_[1] END AS ch FROM s2)
{_OUT}""")
def resolved_profiles(src):
    context = _context(src)
    scored = candidates.score_candidates(candidates.distinct_candidates(src("candidates")), context)
    return _flat(candidates.resolve(scored))


_ANSWERS = """ans AS (SELECT profile_id, TRY_CAST(json_extract_string(js, '$.winner_index') AS int) AS wi FROM (SELECT profile_id, CASE WHEN contains(text, '{') THEN regexp_extract(text, '(\\{.*\\})', 1, 's') END AS js FROM arbiter_responses))"""


_ARBITRATED = f"""WITH {_PICK}, {_ANSWERS},
s4 AS (SELECT s2.*, a.profile_id IS NOT NULL AND mx >= min_score AND (n_near >= 2 OR mx = min_score) AS asked, wi, least(5, CASE WHEN n_near >= 2 THEN n_near ELSE 2 END, len(all_)) AS ps FROM s2 LEFT JOIN ans a ON a.profile_id = s2.profile_id),
s3 AS (SELECT *, CASE WHEN mx < min_score THEN 'too_weak' WHEN asked AND NOT coalesce(wi BETWEEN 0 AND ps - 1, false) THEN 'arbiter_abstained' WHEN asked THEN 'arbiter_selected' WHEN nt > 3 AND NOT lone AND len(strongest) > 1 THEN 'ambiguous' ELSE 'selected' END AS outcome,
  CASE WHEN asked THEN all_[wi + 1] WHEN nt > 1 AND NOT lone AND len(strongest) = 1 THEN strongest[1] ELSE all_[1] END AS ch FROM s4)"""


@query("resolved_with_arbiter", f"{_ARBITRATED} {_OUT}")
def resolved_with_arbiter(src):
    context = _context(src)
    scored = candidates.score_candidates(candidates.distinct_candidates(src("candidates")), context)
    answers = replies.parse_arbiter(src("arbiter_responses"))
    return _flat(candidates.resolve(scored, answers))


_CAPTURED = """cap AS (SELECT * FROM (SELECT profile_id, rtrim(lower(trim(url)), '/') AS url_key, pos, trim(url) AS url, substr(title, 1, 200) AS title, substr(description, 1, 400) AS description, label AS source,
 row_number() OVER (PARTITION BY profile_id, rtrim(lower(trim(url)), '/') ORDER BY pos) AS rn FROM web_results WHERE trim(url) <> '' AND NOT contains(lower(url), 'linkedin.com')
 AND NOT regexp_matches(lower(url), 'spokeo\\.com|beenverified|whitepages|radaris|truepeoplesearch|peekyou|rocketreach|clearbit|zoominfo|apollo\\.io')) WHERE rn = 1)"""
_GRADED = _CAPTURED + f""",
who AS (SELECT id, string_split_regex(trim(lower(name)), '\\s+')[1] AS f, CASE WHEN len(string_split_regex(trim(name), '\\s+')) > 1 THEN string_split_regex(trim(lower(name)), '\\s+')[-1] ELSE '' END AS l,
 regexp_extract({DOMAIN_SQL.format(e='email')}, '([^.]+\\.[^.]+|[^.]+)$', 1) AS b, twitter_url <> '' AS ht, website_url <> '' AS hw FROM people),
gr AS (SELECT cap.*, ht, hw, CASE WHEN source = 'email-exact' OR (b <> '' AND b NOT IN ('gmail.com','hotmail.com','yahoo.com','outlook.com','me.com','icloud.com','aol.com','proton.me','protonmail.com','msn.com','live.com','hey.com','pm.me') AND contains(lower(url), b))
  OR (f <> '' AND l <> '' AND len(list_filter([f||'-'||l, f||'_'||l, f||'.'||l, f||l, l||'-'||f, l||f], lambda x: length(x) >= 7 AND contains(lower(url), x))) > 0) THEN 'strong'
  WHEN f <> '' AND l <> '' AND contains(lower(title || ' ' || description), f) AND contains(lower(title || ' ' || description), l) THEN 'medium' ELSE 'none' END AS grade FROM cap JOIN who ON who.id = cap.profile_id)"""


@query("captured_evidence", f"WITH {_CAPTURED} SELECT profile_id, url_key, pos, url, title, description, source FROM cap")
def captured_evidence(src):
    return candidates.capture_evidence(src("web_results"))


@query("graded_evidence", f"WITH {_GRADED} SELECT profile_id, url_key, pos, grade FROM gr")
def graded_evidence(src):
    graded = candidates.grade_evidence(candidates.capture_evidence(src("web_results")), src("people"))
    return graded.select("profile_id", "url_key", "pos", "grade")


@query("assigned_evidence", f"""WITH {_GRADED},
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS place FROM gr) WHERE place <= 20 AND grade <> 'none'),
wa AS (SELECT *, CASE WHEN grade <> 'strong' THEN '' WHEN contains(lower(url), 'github.com') THEN 'other_links' WHEN regexp_matches(lower(url), 'twitter\\.com|://x\\.com/') THEN 'twitter_url' WHEN regexp_matches(lower(url), 'substack\\.com|\\.edu/|medium\\.com|scholar\\.google') THEN 'other_links' ELSE 'website_url' END AS want FROM pl)
SELECT profile_id, cast(place AS int) AS place, url, grade, CASE WHEN want IN ('', 'other_links') THEN want WHEN (want = 'twitter_url' AND ht) OR (want = 'website_url' AND hw) OR row_number() OVER (PARTITION BY profile_id, want ORDER BY place) > 1 THEN 'other_links' ELSE want END AS slot,
 concat('search_evidence(', grade, '):', substr(url, 1, 80)) AS text_key, trim(title || chr(10) || description) AS snippet FROM wa""")
def assigned_evidence(src):
    graded = candidates.grade_evidence(candidates.capture_evidence(src("web_results")), src("people"))
    return candidates.assign_evidence(graded, src("people"))
