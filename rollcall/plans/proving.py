"""Queries of the evidence, verification and vendor-payload operators."""

from pyspark.sql import functions as F

from rollcall.functions.replies import parse_arbiter
from rollcall.operators import candidates, evidence, reports, verification
from rollcall.plans.keeping import VALID
from rollcall.plans.normalising import DOMAIN_SQL, PAGE_TEXT, PERSONAL, SIGNAL_TOKENS
from rollcall.plans.registry import query
from rollcall.plans.resolving import _ARBITRATED, _context

_SIGNALS = f"""sg0 AS (SELECT id, organization, email, {SIGNAL_TOKENS.format(c='name')} AS toks, {DOMAIN_SQL.format(e='email')} AS dom FROM people),
sg1 AS (SELECT *, toks[1:coalesce(list_max(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN toks[i] IN ('jr','sr','ii','iii','iv','phd','md','esq','mba','mph','dphil','ma','ms','bs','ba','jd','ph','d','m') THEN 0 ELSE i END)), 0)] AS tk FROM sg0),
sg2 AS (SELECT id AS profile_id, organization, CASE WHEN dom = '' THEN 'no_email' WHEN dom IN {PERSONAL} THEN 'personal' WHEN regexp_matches(dom, '(\\.edu|\\.ac\\.uk|\\.edu\\.au)$') THEN 'edu' WHEN regexp_matches(dom, '(\\.gov|\\.gov\\.uk)$') THEN 'gov' WHEN dom LIKE '%.org' THEN 'org' ELSE 'corp' END AS cohort,
  CASE WHEN dom IN {PERSONAL} THEN '' ELSE dom END AS org_domain, CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 1)) ELSE '' END AS email_local, coalesce(tk[1], '') AS f, CASE WHEN len(tk) > 1 THEN tk[-1] ELSE '' END AS l FROM sg1),
sg AS (SELECT *, CASE WHEN f <> '' AND l <> '' THEN list_filter([CASE WHEN length(f||'-'||l) >= 5 THEN f||'-'||l END, CASE WHEN length(f||l) >= 5 THEN f||l END, CASE WHEN length(f||'.'||l) >= 5 THEN f||'.'||l END, CASE WHEN length(f||'_'||l) >= 5 THEN f||'_'||l END,
  CASE WHEN length(l||'-'||f) >= 5 THEN l||'-'||f END, CASE WHEN length(l||f) >= 5 THEN l||f END, CASE WHEN length(l) >= 3 THEN f[1]||l END, CASE WHEN length(l) >= 3 THEN f[1]||'-'||l END, CASE WHEN length(f) >= 4 THEN f||l[1] END, CASE WHEN length(f) >= 3 THEN f||'-'||l[1] END], lambda x: x IS NOT NULL)
  WHEN length(f) >= 5 THEN [f] ELSE [] END AS slugs FROM sg2)"""
_SORTED = "array_to_string(list_sort(list_filter([{0}], lambda x: x IS NOT NULL)), ',')"


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query("profile_signals", f"""WITH {_SIGNALS}
SELECT profile_id, cohort, org_domain, email_local, f AS first, l AS last, array_to_string(slugs, ',') AS name_slugs FROM sg""")
def profile_signals(src):
    return _joined(evidence.profile_signals(src("people")), "name_slugs").drop("organization")


_A = r"'<a\s([^>]*)>(.*?)</a\s*>'"
_ORG_SITE = f"""lk0 AS (SELECT url AS page_url, html, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS org_domain, unnest(regexp_extract_all(html, {_A}, 1, 'is')) AS a, unnest(regexp_extract_all(html, {_A}, 2, 'is')) AS t, unnest(range(0, len(regexp_extract_all(html, {_A}, 1, 'is')))) AS link_no FROM team_pages),
lk1 AS (SELECT page_url, html, org_domain, link_no, trim(regexp_extract(a, '(?:^|\\s)href\\s*=\\s*["'']?([^"''\\s>]*)', 1, 'is')) AS href, trim(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS txt FROM lk0),
lk AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '/%' THEN concat('https://', org_domain, href) ELSE concat(page_url, href) END AS url FROM lk1 WHERE href <> '' AND href NOT LIKE 'mailto%'),
gp AS (SELECT DISTINCT org_domain, f, l, slugs FROM sg WHERE org_domain <> '' AND f <> '' AND (l <> '' OR length(f) >= 5)),
ht AS (SELECT lk.*, f, l, coalesce(list_filter(slugs, lambda x: contains(lower(regexp_extract(lk.url, '^https?://[^/?#]*([^?#]*)', 1)), x))[1], '') AS slug_hit, CASE WHEN l <> '' THEN contains(lower(txt), f) AND contains(lower(txt), l) ELSE contains(lower(txt), f) AND length(f) >= 5 END AS in_text
  FROM lk JOIN gp ON gp.org_domain = lk.org_domain),
hb AS (SELECT *, {PAGE_TEXT} AS body, lower(coalesce(nullif(txt, ''), slug_hit)) AS needle FROM ht WHERE slug_hit <> '' OR in_text),
hc AS (SELECT *, position(needle IN lower(body)) AS hit FROM hb),
hd AS (SELECT *, CASE WHEN needle = '' OR hit = 0 THEN '' ELSE trim(substr(body, greatest(1, hit - 200), hit + 200 - greatest(1, hit - 200))) END AS snippet, rtrim(regexp_replace(lower(url), '[?#].*$', ''), '/') AS url_key, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS h FROM hc),
he AS (SELECT *, row_number() OVER (PARTITION BY org_domain, f, l, url_key ORDER BY page_url, link_no) AS rn FROM hd)"""


@query("org_site_evidence", f"""WITH {_SIGNALS}, {_ORG_SITE}
SELECT org_domain, f AS first, l AS last, url_key, url, 'org_site' AS source, CASE WHEN contains(h, 'linkedin.com') THEN 'linkedin' WHEN contains(h, org_domain) THEN 'bio' ELSE 'listing' END AS kind, txt AS title, snippet,
 {_SORTED.format("'email_match', CASE WHEN in_text THEN 'name_match' END, CASE WHEN slug_hit <> '' THEN 'slug_match' END, CASE WHEN snippet <> '' AND (contains(lower(snippet), f) OR contains(lower(snippet), l)) THEN 'bio_match' END")} AS anchors FROM he WHERE rn = 1""")
def org_site_evidence(src):
    found = evidence.org_site_evidence(src("team_pages"), evidence.profile_signals(src("people")))
    return _joined(found, "anchors")


@query("open_web_evidence", f"""WITH {_SIGNALS},
ow AS (SELECT w.profile_id, w.pos, w.url, rtrim(regexp_replace(lower(trim(w.url)), '[?#].*$', ''), '/') AS url_key, substr(description, 1, 400) AS snippet, substr(title, 1, 200) AS title,
  contains(lower(title || ' ' || description), f) AND contains(lower(title || ' ' || description), l) AS nm, org_domain <> '' AND contains(lower(w.url), org_domain) AS em, len(list_filter(slugs, lambda x: contains(lower(w.url), x))) > 0 AS sm
  FROM web_results w JOIN sg ON sg.profile_id = w.profile_id WHERE f <> '' AND l <> '' AND NOT regexp_matches(lower(w.url), 'zoominfo\\.com|rocketreach\\.com')),
o1 AS (SELECT *, row_number() OVER (PARTITION BY profile_id, url_key ORDER BY pos) AS rn FROM ow)
SELECT profile_id, url_key, pos, url, 'open_web' AS source, CASE WHEN contains(lower(url), 'linkedin.com') THEN 'linkedin' WHEN contains(lower(url), '://x.com/') THEN 'twitter' ELSE 'website' END AS kind,
 {_SORTED.format("CASE WHEN nm THEN 'name_match' END, CASE WHEN em THEN 'email_match' END, CASE WHEN sm THEN 'slug_match' END")} AS anchors, snippet, title FROM o1 WHERE rn = 1 AND nm::int + em::int + sm::int >= 2""")
def open_web_evidence(src):
    return _joined(evidence.open_web_evidence(src("web_results"), evidence.profile_signals(src("people"))), "anchors")


_NAMED = "(f <> '' AND list_contains({w}, f) AND (l = '' OR list_contains({w}, l)))"


@query("author_evidence", f"""WITH {_SIGNALS},
r AS (SELECT a.profile_id, pos, json_extract_string(body, '$.id') AS url, json_extract_string(body, '$.display_name') AS dn, cast(json_extract_string(body, '$.works_count') AS int) AS wc, lower(json_extract_string(body, '$.last_known_institution.homepage_url')) AS hp,
  lower(json_extract_string(body, '$.last_known_institution.display_name')) AS idn, sg.*, regexp_extract(org_domain, '([^.]+\\.[^.]+|[^.]+)$', 1) AS root FROM author_records a JOIN sg ON sg.profile_id = a.profile_id)
SELECT profile_id, pos, url, 'openalex' AS source, 'profile' AS kind, {_SORTED.format("'name_match', CASE WHEN org_domain <> '' AND (contains(hp, org_domain) OR contains(hp, root) OR contains(idn, split_part(root, '.', 1))) THEN 'email_match' END, CASE WHEN wc >= 1 THEN 'platform_match' END")} AS anchors,
 concat(dn, ' — Acme University (', wc, ' works)') AS snippet, dn AS title FROM r WHERE {_NAMED.format(w="regexp_extract_all(lower(dn), '[a-z]+')")}""")
def author_evidence(src):
    return _joined(evidence.author_evidence(src("author_records"), evidence.profile_signals(src("people"))), "anchors")


@query("code_user_evidence", f"""WITH {_SIGNALS},
r AS (SELECT a.profile_id, pos, json_extract_string(body, '$.login') AS login, json_extract_string(body, '$.name') AS nm, lower(json_extract_string(body, '$.company')) AS company, lower(json_extract_string(body, '$.email')) AS em, json_extract_string(body, '$.bio') AS bio,
  cast(json_extract_string(body, '$.public_repos') AS int) AS repos, sg.f, sg.l, sg.org_domain, sg.slugs FROM code_records a JOIN sg ON sg.profile_id = a.profile_id),
t AS (SELECT *, org_domain <> '' AND em LIKE '%@' || org_domain AS lit, org_domain <> '' AND (contains(company, org_domain) OR contains(em, org_domain)) AS near, bio <> '' AND contains(lower(bio), f) AND (l = '' OR contains(lower(bio), l)) AS bm, len(list_filter(slugs, lambda x: contains(lower(login), x))) > 0 AS sm FROM r WHERE {_NAMED.format(w="regexp_extract_all(lower(nm), '[a-z]+')")})
SELECT profile_id, pos, concat('https://github.com/', login) AS url, 'github' AS source, 'github' AS kind, {_SORTED.format("'name_match', CASE WHEN sm THEN 'slug_match' END, CASE WHEN lit OR near THEN 'email_match' END, CASE WHEN lit THEN 'literal_email' END, CASE WHEN bm THEN 'bio_match' END, CASE WHEN repos >= 1 OR bio <> '' THEN 'platform_match' END")} AS anchors,
 coalesce(nullif(bio, ''), trim(concat(nm, ' @ ', company), ' @')) AS snippet, nm AS title FROM t WHERE sm OR lit OR near OR bm""")
def code_user_evidence(src):
    return _joined(evidence.code_user_evidence(src("code_records"), evidence.profile_signals(src("people"))), "anchors")


@query("publication_evidence", f"""WITH {_SIGNALS},
r AS (SELECT a.profile_id, pos, coalesce(json_extract(body, '$.results[0]'), json_extract(body, '$.publications[0]'), json_extract(body, '$.hits[0]'), json_extract(body, '$.items[0]')) AS j, sg.f, sg.l, sg.slugs FROM publication_records a JOIN sg ON sg.profile_id = a.profile_id),
t AS (SELECT *, coalesce(json_extract_string(j, '$.base_url'), concat('https://', json_extract_string(j, '$.custom_domain'))) AS url, json_extract_string(j, '$.name') AS nm, json_extract_string(j, '$.description') AS ds FROM r),
u AS (SELECT *, {_NAMED.format(w="regexp_extract_all(lower(nm), '[a-z]+')")} AS nmatch, l <> '' AND {_NAMED.format(w="regexp_extract_all(lower(ds), '[a-z]+')")} AS bm, len(list_filter(slugs, lambda x: contains(lower(url), x))) > 0 AS sm FROM t)
SELECT profile_id, pos, url, 'substack' AS source, 'substack' AS kind, {_SORTED.format("CASE WHEN nmatch THEN 'name_match' END, CASE WHEN sm THEN 'slug_match' END, CASE WHEN bm THEN 'bio_match' END, 'platform_match'")} AS anchors, coalesce(nullif(ds, ''), nm) AS snippet, nm AS title FROM u WHERE nmatch OR sm""")
def publication_evidence(src):
    return _joined(evidence.publication_evidence(src("publication_records"), evidence.profile_signals(src("people"))), "anchors")


_EV = """ev AS (SELECT *, rtrim(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/') AS url_key, CASE WHEN anchors_csv = '' THEN [] ELSE string_split(anchors_csv, ',') END AS an FROM evidence)"""
_MERGED = _EV + """,
mg AS (SELECT profile_id, url_key, min(pos) AS pos, arg_min(url, pos) AS url, arg_min(source, pos) AS source, arg_min(kind, pos) AS kind, list_sort(list_distinct(flatten(list(an)))) AS anchors, arg_max(snippet, (length(snippet), -pos)) AS snippet,
  coalesce(arg_min(title, pos) FILTER (title <> ''), '') AS title, list_sort(list(DISTINCT source)) AS sources FROM ev GROUP BY profile_id, url_key)"""


def _rows(src):
    return evidence.evidence_from_csv(src("evidence"))


@query("merged_evidence", f"""WITH {_MERGED}
SELECT profile_id, url_key, pos, url, source, kind, array_to_string(anchors, ',') AS anchors, snippet, title, array_to_string(sources, ',') AS sources FROM mg""")
def merged_evidence(src):
    return _joined(evidence.merge_evidence(_rows(src)), "anchors", "sources")


_VERDICT = """vd AS (SELECT p.id AS profile_id, coalesce(n, 0) AS n_evidence, coalesce(s, 0) AS n_strong, coalesce(w, 0) AS n_weak, coalesce(ws, 0) AS n_weak_sources FROM people p LEFT JOIN (SELECT profile_id, count(*) AS n, count(*) FILTER (len(anchors) >= 2) AS s, count(*) FILTER (len(anchors) = 1) AS w,
  count(DISTINCT source) FILTER (len(anchors) = 1) AS ws FROM {m} GROUP BY profile_id) q ON q.profile_id = p.id),
vs AS (SELECT *, CASE WHEN n_strong > 0 OR (n_weak >= 2 AND n_weak_sources >= 2) THEN 'enriched' WHEN n_weak > 0 THEN 'thin' ELSE 'hidden' END AS state FROM vd)"""


@query("evidence_verdicts", f"""WITH {_MERGED}, {_VERDICT.format(m='mg')}
SELECT profile_id, cast(n_evidence AS bigint) AS n_evidence, cast(n_strong AS bigint) AS n_strong, cast(n_weak AS bigint) AS n_weak, cast(n_weak_sources AS int) AS n_weak_sources, state FROM vs""")
def evidence_verdicts(src):
    return evidence.verdicts(src("people"), evidence.merge_evidence(_rows(src)))


@query("evidence_write_back", f"""WITH {_MERGED},
wn AS (SELECT mg.*, CASE WHEN len(anchors) >= 2 THEN 0 ELSE 1 END AS turn, CASE kind WHEN 'twitter' THEN 'twitter_url' WHEN 'website' THEN 'website_url' WHEN 'bio' THEN 'website_url' WHEN 'github' THEN 'other_links' END AS want, p.twitter_url <> '' AS ht, p.website_url <> '' AS hw, p.source_row % 4 AS sr FROM mg JOIN people p ON p.id = mg.profile_id WHERE len(anchors) >= 1),
wr AS (SELECT *, row_number() OVER (PARTITION BY profile_id, want ORDER BY turn, pos) AS rn FROM wn)
SELECT profile_id, url_key, url, turn, pos, CASE WHEN want = 'other_links' OR rn > 1 OR (want = 'twitter_url' AND ht) OR (want = 'website_url' AND hw) THEN CASE WHEN contains(url_key, concat('//site', sr, '.')) THEN '' ELSE 'other_links' END ELSE want END AS slot,
 concat('evidence(', CASE turn WHEN 0 THEN 'strong' ELSE 'thin' END, ',', source, '):', substr(url, 1, 80)) AS text_key, concat('v2 evidence[', source, '/', kind, ']: ', url, ' anchors=', array_to_string(anchors, ',')) AS log_line FROM wr""")
def evidence_write_back(src):
    # Every person has one of the nine sites in other_links already, in another spelling.
    link = F.concat(F.lit("HTTPS://site"), (F.col("source_row") % 4).cast("string"), F.lit(".example.org/u/"), F.col("source_row").cast("string"), F.lit("/"))
    return evidence.write_back(src("people").withColumn("other_links", F.array(link)), evidence.merge_evidence(_rows(src)))


@query("run_log_lines", f"""WITH {_MERGED}, {_VERDICT.format(m='mg')}
SELECT profile_id, 0 AS part, cast(pos AS bigint) AS pos, concat('v2 evidence[', source, '/', kind, ']: ', url, ' anchors=', array_to_string(anchors, ',')) AS line FROM mg WHERE len(anchors) >= 1 AND profile_id IN (SELECT id FROM people)
UNION ALL SELECT profile_id, 1, 0, CASE state WHEN 'thin' THEN 'v2: thin (1 corroborating anchor)' ELSE 'v2: hidden (no public footprint)' END FROM vs WHERE state <> 'enriched'""")
def run_log_lines(src):
    people, merged = src("people"), evidence.merge_evidence(_rows(src))
    return evidence.run_log(evidence.write_back(people, merged), evidence.verdicts(people, merged))


_STAGED = _EV + """,
es AS (SELECT *, CASE source WHEN 'org_site' THEN 2 WHEN 'openalex' THEN 3 WHEN 'github' THEN 3 WHEN 'linkedin' THEN 4 ELSE 5 END AS stage FROM ev),
ks AS (SELECT profile_id, k, count(*) FILTER (na >= 2) AS s FROM (SELECT profile_id, url_key, k, len(list_distinct(flatten(list(an)))) AS na FROM es, (SELECT unnest([2, 3, 4]) AS k) WHERE stage <= k GROUP BY profile_id, url_key, k) GROUP BY profile_id, k),
co AS (SELECT profile_id, coalesce((SELECT min(k) FROM ks WHERE ks.profile_id = q.profile_id AND s >= 2), 5) AS last_stage FROM (SELECT DISTINCT profile_id FROM ev) q)"""


@query("stage_cutoffs", f"WITH {_STAGED} SELECT profile_id, cast(last_stage AS int) AS last_stage FROM co")
def stage_cutoffs(src):
    return evidence.stage_cutoffs(_rows(src))


@query("staged_profiles", f"""WITH {_STAGED},
kept AS (SELECT es.* FROM es JOIN co ON co.profile_id = es.profile_id AND stage <= last_stage),
km AS (SELECT profile_id, url_key, arg_min(source, pos) AS source, list_distinct(flatten(list(an))) AS anchors FROM kept GROUP BY profile_id, url_key), {_VERDICT.format(m='km')},
li AS (SELECT DISTINCT profile_id FROM kept WHERE source = 'linkedin')
SELECT vs.profile_id, state, CASE WHEN state IN ('enriched', 'thin') THEN 'enriched' ELSE 'skipped' END AS enrichment_status, cast(n_evidence AS bigint) AS n_evidence, cast(n_strong AS bigint) AS n_strong, cast(coalesce(last_stage, 5) AS int) AS last_stage,
 round(CASE WHEN li.profile_id IS NOT NULL THEN 2 * 0.006::double + 0.0168::double ELSE 0 END + CASE WHEN coalesce(last_stage, 5) = 5 THEN 2 * 0.006::double ELSE 0 END, 6) AS cost FROM vs LEFT JOIN co ON co.profile_id = vs.profile_id LEFT JOIN li ON li.profile_id = vs.profile_id""")
def staged_profiles(src):
    return evidence.staged_profiles(src("people"), _rows(src))


@query("resolver_evidence", f"""WITH {_SIGNALS}, {_MERGED},
rs AS (SELECT sg.*, regexp_replace(regexp_replace(rtrim(trim(v.url), '/'), '[?#].*$', ''), '^http://', 'https://') AS url, CASE WHEN v.full_name = '' THEN 'low' ELSE 'high' END AS conf FROM vendor v JOIN sg ON sg.profile_id = v.profile_id)
SELECT profile_id, cast(0 AS bigint) AS pos, url, 'linkedin' AS source, 'linkedin' AS kind, {_SORTED.format("CASE WHEN conf = 'high' THEN 'name_match' END, 'platform_match', CASE WHEN len(list_filter(slugs, lambda x: contains(lower(url), x))) > 0 THEN 'slug_match' END")} AS anchors, '' AS snippet, '' AS title FROM rs""")
def resolver_evidence(src):
    resolved = src("vendor").select(
        "profile_id", F.col("url").alias("linkedin_url"), F.when(F.col("full_name") == "", "low").otherwise("high").alias("confidence"))
    return _joined(evidence.resolver_evidence(resolved, evidence.profile_signals(src("people")), _rows(src)), "anchors")


@query("resolver_side_evidence", f"""WITH {_SIGNALS},
rw AS (SELECT w.*, trim(w.url) AS u, f <> '' AND l <> '' AND contains(lower(w.title || ' ' || description), f) AND contains(lower(w.title || ' ' || description), l) AS nm, org_domain <> '' AND contains(lower(w.url), org_domain) AS em, len(list_filter(slugs, lambda x: contains(lower(w.url), x))) > 0 AS sm
  FROM web_results w JOIN sg ON sg.profile_id = w.profile_id JOIN people p ON p.id = w.profile_id WHERE trim(w.url) <> '' AND NOT {VALID.format(u='p.linkedin_url')})
SELECT profile_id, pos, u AS url, 'open_web' AS source, 'website' AS kind, {_SORTED.format("CASE WHEN nm THEN 'name_match' END, CASE WHEN em THEN 'email_match' END, CASE WHEN sm THEN 'slug_match' END")} AS anchors, substr(description, 1, 400) AS snippet, substr(title, 1, 200) AS title FROM rw WHERE nm OR em OR sm""")
def resolver_side_evidence(src):
    return _joined(evidence.resolver_side_evidence(src("web_results"), evidence.profile_signals(src("people")), src("people")), "anchors")


_W5 = r"list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '([\p{{L}}\p{{N}}_]+)', 1), lambda x: regexp_full_match(x, '[a-z]{{5,}}'))), lambda x: x NOT IN ('about','their','these','those','would','could','should','being','other','which','through','between','before','after'))"
_VERIFIED = f"""b0 AS (SELECT *, lower(strip_accents(name)) AS on_, replace(trim(regexp_replace(lower(strip_accents(full_name)), ',?\\s*(ph\\.?d\\.?|mpa|mba|m\\.?d\\.?|jr\\.?|sr\\.?|iii?|iv)$', '', 'i')), '.', '') AS tn, lower(strip_accents(full_name)) AS raw, lower(organization) AS o FROM verify_pairs),
b1 AS (SELECT *, list_filter(string_split_regex(replace(on_, '-', ' '), '\\s+'), lambda x: x <> '') AS ow, list_filter(string_split_regex(replace(tn, '-', ' '), '\\s+'), lambda x: x <> '') AS tw, list_filter(string_split_regex(replace(raw, '-', ' '), '\\s+'), lambda x: x <> '') AS rw FROM b0),
b2 AS (SELECT *, on_ <> '' AND tn <> '' AS cmp, len(ow) >= 2 AS full_, coalesce(ow[1], '') AS f, CASE WHEN len(ow) >= 2 THEN ow[-1] ELSE '' END AS l, CASE WHEN len(list_intersect(ow, tw)) > 0 THEN list_intersect(ow, tw) ELSE list_distinct(list_filter(ow, lambda a: length(a) >= 4 AND len(list_filter(tw, lambda b: length(b) >= 4 AND (starts_with(a, b) OR starts_with(b, a)))) > 0)) END AS ov FROM b1),
b3 AS (SELECT *, CASE WHEN NOT cmp THEN '' WHEN len(ov) = 0 THEN 'name_mismatch' WHEN full_ AND len(ov) = 1 AND list_max(list_transform(ov, lambda x: length(x))) < 5 THEN 'short-token-only' WHEN full_ AND NOT list_contains(ov, l) AND NOT contains(tn, l) THEN 'last-name-missing' ELSE '' END AS rej,
  CASE WHEN NOT cmp OR len(ov) = 0 THEN 'none' WHEN full_ AND list_contains(ov, f) AND list_contains(ov, l) AND length(f) >= 5 AND length(l) >= 5 THEN 'strong' WHEN (full_ AND list_contains(ov, f) AND list_contains(ov, l)) OR (len(ov) >= 2 AND list_min(list_transform(ov, lambda x: length(x))) >= 4) THEN 'normal' ELSE 'weak' END AS st,
  regexp_replace(lower(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)), '[-_.]', '', 'g') AS sc, CASE WHEN len(tw) >= 2 THEN tw[-1] ELSE '' END AS tl, list_filter(list_transform(companies, lambda x: lower(x)), lambda x: x <> '') AS cs, lower(location) AS lo,
  length(content_text) > 200 AND context_block <> '' AS cc, {_W5.format(c='content_text')} AS w1, {_W5.format(c='context_block')} AS w2 FROM b2),
b4 AS (SELECT *, cmp AND sc <> '' AND length(f) >= 3 AND contains(sc, f) AS fs, cmp AND length(l) >= 3 AND contains(sc, l) AS ls, o <> '' AND len(cs) > 0 AS ock, lo <> '' AS lck,
  len(list_filter(cs, lambda x: contains(x, o) OR contains(o, x) OR list_has_any(list_filter(string_split_regex(o, '[\\s&,]+'), lambda w: length(w) > 3), string_split_regex(x, '[\\s&,]+')))) > 0 AS om, contains(lo, lower(city)) OR (length(country) > 3 AND contains(lo, lower(country))) AS lm, len(list_intersect(w1, w2)) AS sw FROM b3),
b5 AS (SELECT *, fs AND ls AS sm, sc <> '' AND NOT fs AND length(tl) >= 3 AND contains(sc, tl) AND tl <> l AS sx, ock AND om AS oy, ock AND NOT om AS onn, lck AND lm AS ly, lck AND NOT lm AS ln, cc AND sw >= 3 AS cy, cc AND sw = 0 AND len(w1) > 10 AS cn, linkedin_url_source = 'user' AS us, len(ow) > 0 AND len(rw) > 0 AND len(list_intersect(ow, rw)) = 0 AS dj FROM b4),
b6 AS (SELECT *, ock::int + lck::int + cc::int AS checks, oy::int + ly::int + cy::int AS po, onn::int + ln::int + cn::int AS pe, CASE st WHEN 'strong' THEN 3 WHEN 'normal' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END + 2 * sm::int + 3 * oy::int + 2 * ly::int + 2 * cy::int - onn::int - ln::int - cn::int AS sco FROM b5),
b7 AS (SELECT *, CASE WHEN us AND dj THEN 'user_provided_but_names_disjoint' WHEN us THEN 'user_provided_linkedin_url_trusted' WHEN rej = 'name_mismatch' THEN concat('name mismatch (''', on_, ''' vs ''', tn, ''')') WHEN rej <> '' THEN concat('weak name match rejected (', rej, ')') WHEN sco < 2 THEN concat('score_below_threshold (score=', sco, ', checks=', checks, ')')
  WHEN st = 'weak' AND po = 0 THEN concat('weak_name_no_corroboration (score=', sco, ', penalties=', pe, ')') WHEN pe > 0 AND po = 0 THEN concat('soft_penalty_no_positive (score=', sco, ', penalties=', pe, ')') ELSE concat('accepted (name=', st, ', positives=', po, ', penalties=', pe, ')') END AS reason FROM b6),
vf AS (SELECT profile_id, url, CASE WHEN us THEN full_name ELSE tn END AS enriched_name, cast(CASE WHEN us AND dj THEN 0 WHEN us THEN 99 WHEN rej <> '' THEN 0 ELSE sco END AS int) AS score,
  list_filter([CASE WHEN us THEN 'user_provided' END, CASE WHEN NOT us AND rej = '' AND st <> 'none' THEN 'name_' || st END, CASE WHEN NOT us AND rej = '' AND sm THEN 'slug_match' END, CASE WHEN NOT us AND rej = '' AND oy THEN 'org_match' END, CASE WHEN NOT us AND rej = '' AND ly THEN 'location_match' END, CASE WHEN NOT us AND rej = '' AND cy THEN 'content_match' END], lambda x: x IS NOT NULL) AS ap,
  list_filter([CASE WHEN us AND dj THEN 'name_zero_overlap' END, CASE WHEN NOT us AND rej = 'name_mismatch' THEN 'name_mismatch' END, CASE WHEN NOT us AND rej NOT IN ('', 'name_mismatch') THEN 'weak_match_' || replace(rej, '-', '_') END, CASE WHEN NOT us AND rej = '' AND sx THEN 'slug_matches_enriched_not_profile' END,
   CASE WHEN NOT us AND rej = '' AND onn THEN 'org_mismatch' END, CASE WHEN NOT us AND rej = '' AND ln THEN 'location_mismatch' END, CASE WHEN NOT us AND rej = '' AND cn THEN 'content_mismatch' END], lambda x: x IS NOT NULL) AS an,
  CASE WHEN reason LIKE 'accepted%' OR reason = 'user_provided_linkedin_url_trusted' THEN 'accept' ELSE 'reject' END AS decision, reason FROM b7)"""


@query("verified_pairs", f"""WITH {_VERIFIED}
SELECT profile_id, url, enriched_name, score, array_to_string(ap, ',') AS anchors_positive, array_to_string(an, ',') AS anchors_negative, decision, reason FROM vf""")
def verified_pairs(src):
    return _joined(verification.verify_pairs(src("verify_pairs")), "anchors_positive", "anchors_negative")


_REASON = " ".join(f"WHEN reason LIKE '{n}%' THEN '{b}'" for n, b in [
    ("score_below_threshold", "score_below_threshold"), ("weak_name_no_corroboration", "weak_name_no_corroboration"), ("soft_penalty_no_positive", "soft_penalty_no_positive"),
    ("weak name match rejected (short-token-only)", "weak_match_short_token"), ("weak name match rejected (last-name-missing)", "weak_match_last_name_missing"), ("name mismatch", "name_mismatch"), ("accepted", "accepted")])


@query("decision_report", f"""WITH {_VERIFIED}
SELECT section, bucket, cast(count(*) AS bigint) AS n FROM (SELECT 'decision' AS section, decision AS bucket FROM vf UNION ALL SELECT 'reason', concat(decision, ':', CASE {_REASON} ELSE 'other' END) FROM vf
 UNION ALL SELECT 'anchor_positive', unnest(ap) FROM vf UNION ALL SELECT 'anchor_negative', unnest(an) FROM vf) GROUP BY section, bucket""")
def decision_report(src):
    return reports.decision_report(verification.verify_pairs(src("verify_pairs")))


_OUTCOME = """CASE WHEN status IN (402, 403) AND contains(lower(body), 'credits') THEN 'out_of_credits' WHEN status = 429 THEN '429_rate_limited_exhausted' WHEN status = 404 THEN '404_not_found' WHEN status BETWEEN 500 AND 599 THEN '5xx_persisted'
 WHEN status <> 200 THEN concat('non_200:', status) WHEN trim(body) = '' THEN 'empty_body' WHEN NOT json_valid(body) THEN 'json_parse_error' WHEN coalesce(json_extract_string(body, '$.error'), '') <> '' THEN 'api_error_field' ELSE 'ok' END"""


@query("payload_outcomes", f"""
SELECT call_id, outcome, outcome IN ('empty_body', 'transient_exhausted', '5xx_persisted', '429_rate_limited_exhausted', 'json_parse_error') OR outcome LIKE 'non_200:5%' AS transient FROM (SELECT call_id, {_OUTCOME} AS outcome FROM calls)""")
def payload_outcomes(src):
    sorted_out = src("calls").select("call_id", verification.classify_payload(F.col("status"), F.col("body")).alias("outcome"))
    return sorted_out.withColumn("transient", verification.is_transient(F.col("outcome")))


@query("parsed_payloads", f"""
WITH g AS (SELECT call_id, body FROM calls WHERE {_OUTCOME} = 'ok')
SELECT call_id, json_extract_string(body, '$.full_name') AS full_name, json_extract_string(body, '$.experiences[0].company') AS current_company, json_extract_string(body, '$.experiences[0].title') AS current_title, json_extract_string(body, '$.city') AS location, cast(2 AS int) AS jobs,
 concat(json_extract_string(body, '$.full_name'), chr(10), 'Experience:', chr(10), '  ', json_extract_string(body, '$.experiences[0].title'), ' at ', json_extract_string(body, '$.experiences[0].company'), ' (2010–2015)', chr(10), '   at Past') AS context_block FROM g""")
def parsed_payloads(src):
    good = src("calls").where(verification.classify_payload(F.col("status"), F.col("body")) == "ok")
    parsed = good.select("call_id", verification.parse_payload(F.col("body")).alias("p"))
    return parsed.select("call_id", "p.full_name", "p.current_company", "p.current_title", "p.location",
                         F.size("p.experience").alias("jobs"), "p.context_block")


@query("settled_candidates", """
WITH t AS (SELECT *, outcome = 'ok' AND verified AS good, outcome = 'out_of_credits' AS broke, outcome IN ('empty_body','transient_exhausted','5xx_persisted','429_rate_limited_exhausted','json_parse_error') OR outcome LIKE 'non_200:5%' AS tr FROM tries),
s AS (SELECT profile_id, min(turn) FILTER (good OR broke) AS stop, arg_min(good, turn) FILTER (good OR broke) AS won, arg_min(url, turn) FILTER (good OR broke) AS lu, count(*) AS n, count(*) FILTER (tr) AS nt, any_value(linkedin_url_source) AS src FROM t GROUP BY profile_id),
c AS (SELECT t.profile_id, count(*) AS calls FROM t JOIN s ON s.profile_id = t.profile_id WHERE NOT broke AND (stop IS NULL OR turn <= stop) GROUP BY 1)
SELECT s.profile_id, CASE WHEN won THEN 'enriched' WHEN stop IS NULL AND n = nt THEN 'pending' ELSE 'failed' END AS enrichment_status, CASE WHEN won THEN lu WHEN src = 'user' THEN NULL ELSE '' END AS new_linkedin_url, cast(coalesce(calls, 0) AS bigint) AS calls, round(coalesce(calls, 0) * 0.0168::double, 6) AS cost,
 CASE WHEN won THEN '' WHEN stop IS NOT NULL THEN 'Out of API credits' WHEN n = nt THEN 'transient' ELSE 'verification failed' END AS error FROM s LEFT JOIN c ON c.profile_id = s.profile_id""")
def settled_candidates(src):
    return verification.settle_candidates(src("tries"))


@query("backfilled_people", """
SELECT id, coalesce(nullif(name, ''), full_name) AS name, coalesce(nullif(organization, ''), current_company) AS organization, coalesce(nullif(title, ''), current_title) AS title, current_company AS enriched_organization, current_title AS enriched_title
FROM people JOIN vendor ON profile_id = id""")
def backfilled_people(src):
    return verification.backfill(src("people"), src("vendor")).select(
        "id", "name", "organization", "title", "enriched_organization", "enriched_title")


@query("arbiter_decisions", f"""{_ARBITRATED}, ab AS (SELECT s3.profile_id, outcome, ch, wi, lower(json_extract_string(js, '$.confidence')) AS c, json_extract_string(js, '$.reason') AS r, js IS NULL AS bad, left(text, 100) AS t FROM s3 JOIN (SELECT profile_id, text, CASE WHEN contains(text, '{{') THEN regexp_extract(text, '(\\{{.*\\}})', 1, 's') END AS js FROM arbiter_responses) q ON q.profile_id = s3.profile_id WHERE outcome LIKE 'arbiter%')
SELECT profile_id, CASE WHEN outcome = 'arbiter_selected' THEN ch.url ELSE '' END AS linkedin_url, 0 AS score, 'arbiter_called' AS anchors_positive, '' AS anchors_negative, CASE WHEN outcome = 'arbiter_selected' THEN 'accept' ELSE 'ambiguous' END AS decision,
 concat(CASE WHEN wi IS NULL THEN 'arbiter abstained' ELSE concat('arbiter selected index=', wi) END, ' (confidence=', CASE WHEN c IN ('high', 'medium', 'low') THEN c ELSE 'low' END, ', reason=', CASE WHEN bad THEN concat('arbiter_parse_error: ', t) ELSE coalesce(nullif(r, ''), 'no-reason') END, ')') AS reason FROM ab""")
def arbiter_decisions(src):
    scored = candidates.score_candidates(candidates.distinct_candidates(src("candidates")), _context(src))
    answers = parse_arbiter(src("arbiter_responses"))
    return _joined(candidates.arbiter_decisions(candidates.resolve(scored, answers), answers), "anchors_positive", "anchors_negative")
