"""Queries of the duplicate and person-identifier operators."""

from pyspark.sql import functions as F

from rollcall.operators import dedup
from rollcall.plans.normalising import _NAME_KEY, _ORG_KEY
from rollcall.plans.registry import query

_KEYED = """SELECT *, trim(lower(email)) AS ek, regexp_replace(rtrim(lower(trim(linkedin_url)), '/'), '[?#].*$', '') AS uk,
 {n} AS nk, {o} AS ok FROM {t}"""
_N = _KEYED.format(n=_NAME_KEY.format(c="name"), o=_ORG_KEY.format(c="organization"), t="people")
_K = _KEYED.format(n=_NAME_KEY.format(c="name"), o=_ORG_KEY.format(c="organization"), t="known_people")
_INDEX = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY dataset_id DESC, pos DESC, id DESC) AS rn FROM k WHERE {k} <> '') WHERE rn = 1)"""
_BOTH = f"WITH n AS ({_N}), k AS ({_K}), ei AS ({_INDEX.format(k='ek')}), ui AS ({_INDEX.format(k='uk')})"
_MATCHES = _BOTH + """,
pairs AS (SELECT n.id AS new_id, k.id AS existing_id, CASE WHEN n.ok = '' OR k.ok = '' THEN 0.6 WHEN contains(n.ok, k.ok) OR contains(k.ok, n.ok) THEN 0.9 ELSE 0.5 END AS c FROM n JOIN k ON n.nk = k.nk WHERE n.nk <> ''),
em AS (SELECT n.id AS new_id, ei.id AS existing_id FROM n JOIN ei ON n.ek = ei.ek), um AS (SELECT n.id AS new_id, ui.id AS existing_id FROM n JOIN ui ON n.uk = ui.uk),
m AS (SELECT new_id, 'email' AS match_type, cast(1.0 AS double) AS confidence, existing_id FROM em
 UNION ALL SELECT new_id, 'linkedin', cast(1.0 AS double), existing_id FROM um WHERE (new_id, existing_id) NOT IN (SELECT (new_id, existing_id) FROM em)
 UNION ALL SELECT new_id, 'name_org', cast(c AS double), existing_id FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM em WHERE em.new_id = p.new_id AND em.existing_id = p.existing_id) AND NOT EXISTS (SELECT 1 FROM um WHERE um.new_id = p.new_id AND um.existing_id = p.existing_id))"""


@query("duplicates_by_email", _BOTH + """
SELECT n.id AS new_id, ei.id AS existing_id, ei.dataset_id AS existing_dataset_id, 'email' AS match_type, cast(1.0 AS double) AS confidence FROM n JOIN ei ON n.ek = ei.ek""")
def duplicates_by_email(src):
    return dedup.match_by_email(src("people"), src("known_people"))


@query("duplicates_by_url", _BOTH + """
SELECT n.id AS new_id, ui.id AS existing_id, ui.dataset_id AS existing_dataset_id, 'linkedin' AS match_type, cast(1.0 AS double) AS confidence FROM n JOIN ui ON n.uk = ui.uk""")
def duplicates_by_url(src):
    return dedup.match_by_url(src("people"), src("known_people"))


@query("duplicates_by_name", _MATCHES + """
SELECT new_id, cast(count(*) FILTER (c = 0.9) AS bigint) AS n_likely, cast(count(*) FILTER (c = 0.6) AS bigint) AS n_unclear, cast(count(*) FILTER (c = 0.5) AS bigint) AS n_unlikely,
 min(existing_id) FILTER (c = 0.9) AS first_likely, min(existing_id) FILTER (c = 0.6) AS first_unclear FROM pairs GROUP BY new_id""")
def duplicates_by_name(src):
    return dedup.match_by_name(src("people"), src("known_people"))


@query("duplicates_combined", _MATCHES + """
SELECT new_id, match_type, confidence, cast(count(*) AS bigint) AS n_existing, CASE WHEN confidence > 0.55 THEN min(existing_id) END AS existing_id FROM m GROUP BY new_id, match_type, confidence""")
def duplicates_combined(src):
    return dedup.find_duplicates(src("people"), src("known_people"))


_GROUPS = _BOTH + """,
ng AS (SELECT DISTINCT nk, ok FROM n WHERE nk <> ''), kg AS (SELECT DISTINCT nk, ok FROM k WHERE nk <> ''),
level AS (SELECT ng.nk, ng.ok AS nok, kg.ok AS kok, CASE WHEN ng.ok = '' OR kg.ok = '' THEN 0.6 WHEN contains(ng.ok, kg.ok) OR contains(kg.ok, ng.ok) THEN 0.9 ELSE 0.5 END AS c FROM ng JOIN kg ON ng.nk = kg.nk)"""


@query("duplicate_group_links", _GROUPS + """
SELECT nk AS name_key, nok AS new_org, kok AS known_org, cast(c AS double) AS confidence FROM level WHERE c > 0.55
UNION ALL SELECT DISTINCT nk, nok, NULL, cast(0.5 AS double) FROM level WHERE c < 0.55""")
def duplicate_group_links(src):
    links = dedup.duplicate_tables(src("people"), src("known_people")).links
    return links.select("new_group.name_key", F.col("new_group.org_key").alias("new_org"),
                        F.col("known_group.org_key").alias("known_org"), "confidence")


@query("duplicate_group_members", _BOTH + """
SELECT 'new' AS side, nk AS name_key, ok AS org_key, id FROM n WHERE nk <> '' UNION ALL SELECT 'known', nk, ok, id FROM k WHERE nk <> ''""")
def duplicate_group_members(src):
    tables = dedup.duplicate_tables(src("people"), src("known_people"))
    return tables.new_members.select(F.lit("new").alias("side"), "new_group.*", F.col("new_id").alias("id")).unionByName(
        tables.known_members.select(F.lit("known").alias("side"), "known_group.*", F.col("existing_id").alias("id")))


@query("duplicate_exact_links", _MATCHES + """
SELECT new_id, existing_id, match_type FROM m WHERE confidence > 0.95""")
def duplicate_exact_links(src):
    return dedup.duplicate_tables(src("people"), src("known_people")).exact.select("new_id", "existing_id", "match_type")


@query("duplicate_pairs", _MATCHES + """
SELECT new_id, existing_id, match_type, confidence FROM m""")
def duplicate_pairs(src):
    return dedup.expanded(dedup.duplicate_tables(src("people"), src("known_people"), stored=True))


@query("duplicates_marked", _MATCHES + """
SELECT p.id, CASE WHEN s.c IS NOT NULL AND p.enrichment_status = 'pending' THEN 'enriched' ELSE p.enrichment_status END AS enrichment_status,
 s.c IS NOT NULL AND p.enrichment_status = 'pending' AS already_enriched, s.c AS duplicate_confidence
FROM people p LEFT JOIN (SELECT new_id, max(confidence) AS c FROM m WHERE confidence > 0.85 GROUP BY new_id) s ON s.new_id = p.id""")
def duplicates_marked(src):
    return dedup.mark_duplicates(src("people"), src("known_people")).select(
        "id", "enrichment_status", "already_enriched", "duplicate_confidence")


@query("already_known_people", """
SELECT id FROM people WHERE (linkedin_url <> '' AND rtrim(lower(linkedin_url), '/') IN (SELECT rtrim(lower(linkedin_url), '/') FROM known_people))
 OR (email <> '' AND lower(email) IN (SELECT lower(email) FROM known_people))""")
def already_known_people(src):
    return dedup.already_known(src("people"), src("known_people")).select("id")


PERSON_ID = """left(md5(account_id || ':' || CASE WHEN trim(email) <> '' THEN 'email:' || lower(trim(email)) WHEN trim(linkedin_url) <> '' THEN 'li:' || rtrim(lower(trim(linkedin_url)), '/')
 WHEN trim(name) <> '' THEN 'name:' || lower(trim(name)) || '|' || lower(trim(organization)) ELSE 'none:' || id END), 12)"""


@query("person_ids", f"SELECT id, {PERSON_ID} AS person_id FROM people")
def person_ids(src):
    return dedup.with_person_id(src("people")).select("id", "person_id")


@query("persons_per_account", f"""
SELECT account_id, cast(count(*) AS bigint) AS rows, cast(count(DISTINCT {PERSON_ID}) AS bigint) AS persons FROM people GROUP BY account_id""")
def persons_per_account(src):
    return dedup.persons_per_account(src("people"))


@query("person_groups", """
WITH RECURSIVE k AS (SELECT id, unnest([CASE WHEN trim(email) <> '' THEN 'email:' || lower(trim(email)) END, CASE WHEN trim(linkedin_url) <> '' THEN 'li:' || rtrim(lower(trim(linkedin_url)), '/') END,
 CASE WHEN trim(name) <> '' THEN 'name:' || lower(trim(name)) || '|' || lower(trim(organization)) END]) AS key FROM people),
m AS (SELECT key, min(id) AS low FROM k WHERE key IS NOT NULL GROUP BY key),
e AS (SELECT DISTINCT id AS x, low AS y FROM k JOIN m ON m.key = k.key), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT id, id AS seen FROM people UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.seen)
SELECT id, min(seen) AS group_id FROM r GROUP BY id""")
def person_groups(src):
    return dedup.linked_persons(src("people"))


@query("shared_profile_urls", """
SELECT rtrim(lower(linkedin_url), '/') AS url_key, cast(count(*) AS bigint) AS n_profiles, min(id) AS first_id FROM people WHERE linkedin_url <> '' GROUP BY 1 HAVING count(*) > 1""")
def shared_profile_urls(src):
    return dedup.shared_urls(src("people"))
