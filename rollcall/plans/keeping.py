"""Queries of sources, sinks, column typing, intake, upkeep and cards."""

import uuid

from pyspark.sql import functions as F

from rollcall.operators import cards, columns, dedup, intake, keyed, reports, upkeep
from rollcall.plans.deduplication import _MATCHES, PERSON_ID
from rollcall.plans.normalising import _ARTICLE
from rollcall.plans.registry import query
from rollcall.session import checkpoint_dir
from rollcall.sources import sinks, store, uploads

VALID = "(regexp_matches({u}, '/in/|/company/') AND NOT regexp_matches({u}, '/public-profile/settings|/feed/|/pub/dir/'))"


# --- sources -----------------------------------------------------------------------------
@query("exploded_records", """
WITH r AS (SELECT page_no, unnest(json_extract(body, '$.records[*]')) AS r, unnest(range(0, len(json_extract(body, '$.records[*]')))) AS record_no FROM record_pages)
SELECT page_no, cast(record_no AS int) AS record_no, json_extract_string(r, '$.id') AS record_id, json_extract_string(r, '$.fields.Name') AS name,
 coalesce(array_to_string(cast(json_extract(r, '$.fields.Tags') AS varchar[]), ', '), '') AS tags, coalesce(json_extract_string(r, '$.fields.Total'), '') AS total FROM r""")
def exploded_records(src):
    records = uploads.explode_records(src("record_pages"))
    as_map = F.map_from_entries("fields")
    value = lambda k: F.coalesce(F.try_element_at(as_map, F.lit(k)), F.lit(""))
    return records.select("page_no", "record_no", "record_id", value("Name").alias("name"), value("Tags").alias("tags"), value("Total").alias("total"))


@query("record_columns", """
WITH r AS (SELECT page_no, unnest(json_extract(body, '$.records[*]')) AS r, unnest(range(0, len(json_extract(body, '$.records[*]')))) AS record_no FROM record_pages),
c AS (SELECT page_no, record_no, unnest(json_keys(r, '$.fields')) AS k, unnest(range(0, len(json_keys(r, '$.fields')))) AS f FROM r)
SELECT k AS "column", cast(count(*) AS bigint) AS filled, arg_min(page_no, (page_no, record_no, f)) AS first_page, cast(arg_min(record_no, (page_no, record_no, f)) AS int) AS first_record FROM c GROUP BY k""")
def record_columns(src):
    return uploads.record_columns(uploads.explode_records(src("record_pages")))


@query("dataset_catalogue", """
SELECT concat('d', s_nationkey) AS dataset_id, s_name AS name, s_suppkey AS created_at, coalesce(n, 0)::bigint AS profile_count FROM supplier LEFT JOIN (SELECT dataset_id, count(*) AS n FROM people GROUP BY 1) p ON p.dataset_id = concat('d', s_nationkey)""")
def dataset_catalogue(src):
    datasets = src("supplier").select(
        F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("dataset_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("created_at"))
    return store.catalogue(datasets, src("people"))


_VERSIONED = "SELECT concat('p', o_custkey) AS id, o_orderkey AS version, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('v', o_orderstatus) END AS enrichment_version FROM orders"


@query("upserted_people", f"""
WITH c AS ({_VERSIONED}), l AS (SELECT id, arg_max(title, version) AS title, arg_max(enrichment_version, version) AS ev FROM c GROUP BY id)
SELECT coalesce(p.id, l.id) AS id, p.name AS name, CASE WHEN l.id IS NOT NULL THEN l.title ELSE p.title END AS title, CASE WHEN l.id IS NOT NULL THEN coalesce(nullif(l.ev, ''), p.enrichment_version, '') ELSE p.enrichment_version END AS enrichment_version FROM people p FULL JOIN l ON l.id = p.id""")
def upserted_people(src):
    changes = src("orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("v"), F.col("o_orderstatus"))).alias("enrichment_version"))
    return store.upsert(src("people").select("id", "name", "title", "enrichment_version"), changes)


@query("updated_people", """
SELECT p.id, p.dataset_id, coalesce(v.current_title, p.title) AS title FROM people p LEFT JOIN vendor v ON v.profile_id = p.id""")
def updated_people(src):
    changes = src("vendor").select(F.col("profile_id").alias("id"), F.col("current_title").alias("title"), F.lit("x").alias("dataset_id"))
    return store.update(src("people").select("id", "dataset_id", "title"), changes)


@query("edited_metadata", """
SELECT c.c_custkey AS id, coalesce(CASE WHEN s.s_acctbal > 5000 THEN s.s_name END, c.c_name) AS name FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def edited_metadata(src):
    stored = src("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = src("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("name"))
    return store.edit_metadata(stored, changes, "id")


@query("appended_chunk", """
SELECT id, dataset_id, source_row FROM people UNION ALL SELECT concat('n', s_suppkey), concat('d', s_nationkey % 6), s_suppkey + coalesce(m, 0) FROM supplier LEFT JOIN (SELECT dataset_id, max(source_row) + 1 AS m FROM people GROUP BY 1) q ON q.dataset_id = concat('d', s_nationkey % 6)""")
def appended_chunk(src):
    chunk = src("supplier").select(
        F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("d"), (F.col("s_nationkey") % 6).cast("string")).alias("dataset_id"),
        F.col("s_suppkey").alias("source_row"))
    return store.append_chunk(src("people").select("id", "dataset_id", "source_row"), chunk)


@query("deleted_datasets", "SELECT id, dataset_id FROM people WHERE dataset_id NOT IN (SELECT concat('d', r_regionkey) FROM region WHERE r_name < 'B')")
def deleted_datasets(src):
    gone = src("region").where("r_name < 'B'").select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("dataset_id"))
    people = src("people").select("id", "dataset_id")
    return store.delete_datasets(people.select("dataset_id").distinct(), people, gone)[1]


@query("looked_up_people", "SELECT id, name FROM people WHERE account_id = 'a1' AND id IN (SELECT concat('p', o_custkey) FROM orders WHERE o_orderstatus = 'P')")
def looked_up_people(src):
    ids = src("orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id"))
    return store.look_up(src("people"), ids, "a1").select("id", "name")


@query("account_scope", "SELECT id FROM people WHERE account_id = 'a2'")
def account_scope(src):
    return store.in_account(src("people"), "a2").select("id")


@query("replaced_rules", """
SELECT c_nationkey AS account_id, c_name AS rule FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, s_name FROM supplier""")
def replaced_rules(src):
    stored = src("customer").select(F.col("c_nationkey").alias("account_id"), F.col("c_name").alias("rule"))
    return store.replace_all(stored, src("supplier").select(F.col("s_nationkey").alias("account_id"), F.col("s_name").alias("rule")))


@query("union_of_datasets", """
SELECT id, dataset_id, name, country FROM people UNION ALL SELECT id, dataset_id, name, NULL FROM known_people""")
def union_of_datasets(src):
    return store.union_datasets(src("people").select("id", "dataset_id", "name", "country"), src("known_people").select("id", "dataset_id", "name"))


@query("conformed_people", f"""
SELECT id, dataset_id, CASE WHEN enrichment_status IN ('pending', 'enriched', 'failed', 'skipped') THEN enrichment_status ELSE 'pending' END AS enrichment_status, '' AS phone, {PERSON_ID} AS person_id FROM people""")
def conformed_people(src):
    old = src("people").withColumns({"junk": F.lit(1), "other_links": F.lit('["a"]')})
    return store.conform(store.with_person_id(old)).select("id", "dataset_id", "enrichment_status", "phone", "person_id")


@query("imported_searches", """
SELECT left(md5(concat('b1|', s_suppkey, '|', s_name, '|', 'who works in ', s_nationkey)), 8) AS search_id, s_name AS name, concat('who works in ', s_nationkey) AS query FROM supplier""")
def imported_searches(src):
    body = F.to_json(F.struct(F.col("s_name").alias("name"), F.concat(F.lit("who works in "), F.col("s_nationkey").cast("string")).alias("query")))
    return store.import_searches(src("supplier").select(F.col("s_suppkey").cast("string").alias("origin"), body.alias("body")), "b1").select(
        "search_id", "name", "query")


@query("legacy_corpus_text", r"""
SELECT id, trim(concat_ws(chr(10) || chr(10), CASE WHEN trim(linkedin_url) <> '' THEN concat('linkedin:', chr(10), trim(linkedin_url)) END, CASE WHEN trim(title) <> '' THEN concat('pitch:', chr(10), trim(title)) END)) AS raw_text FROM people""")
def legacy_corpus_text(src):
    rows = src("people").select("id", F.col("title").alias("pitch"), F.col("linkedin_url").alias("linkedin"), F.col("country").alias("category"))
    return uploads.corpus_text(rows).select("id", "raw_text")


@query("coalesced_columns", """
SELECT id, coalesce(nullif(title, ''), nullif(organization, ''), country) AS role, coalesce(nullif(email, ''), nullif(twitter_url, ''), '') AS contact FROM people""")
def coalesced_columns(src):
    people = src("people")
    return uploads.coalesce_columns(people, {"id": ["id"], "role": ["title", "missing", "organization", "country"], "contact": ["email", "twitter_url"]})


@query("write_back_outbox", """
WITH t AS (SELECT concat('rec', p.source_row) AS record_id, p.*, d.text AS vt FROM people p LEFT JOIN documents d ON d.doc_id = p.source_row WHERE linkedin_url_source <> 'user'),
u AS (SELECT *, left(md5(record_id), 2) AS batch_group FROM t)
SELECT record_id, nullif(linkedin_url, '') AS "RC_LinkedIn_URL", nullif(left(vt, 100000), '') AS "RC_LinkedIn_Enriched", nullif(name, '') AS "RC_Profile_Card", enrichment_status AS "RC_Enrichment_Status", '2024-01-01T00:00:00Z' AS "RC_Last_Enriched",
 batch_group, cast(floor((row_number() OVER (PARTITION BY batch_group ORDER BY record_id) - 1) / 10) AS int) AS batch_no FROM u""")
def write_back_outbox(src):
    texts = src("documents").select(F.col("doc_id").alias("source_row"), F.col("text").alias("vendor_text"))
    rows = src("people").join(texts, "source_row", "left").withColumns({
        "record_id": F.when(F.col("linkedin_url_source") == "user", "").otherwise(F.concat(F.lit("rec"), F.col("source_row").cast("string"))),
        "profile_card": F.col("name")})
    return sinks.outbox(rows, F.lit("2024-01-01T00:00:00Z"))


@query("outbox_counts", """
SELECT cast(count(*) FILTER (linkedin_url_source <> 'user') AS bigint) AS to_send, cast(count(*) FILTER (linkedin_url_source = 'user') AS bigint) AS skipped FROM people""")
def outbox_counts(src):
    return sinks.outbox_counts(src("people").withColumn("record_id", F.when(F.col("linkedin_url_source") == "user", "").otherwise(F.col("id"))))


@query("numbered_batches", """
SELECT id, left(md5(id), 2) AS batch_group, cast(floor((row_number() OVER (PARTITION BY left(md5(id), 2) ORDER BY id) - 1) / 40) AS int) AS batch_no FROM people""")
def numbered_batches(src):
    return keyed.number_batches(src("people").select("id"), "id", 40)


# --- columns ------------------------------------------------------------------------------
_HEAD = "(SELECT * FROM people ORDER BY source_row LIMIT 20)"
_COLS = ["name", "email", "organization", "title", "linkedin_url", "twitter_url", "country"]


@query("column_samples", f"""
SELECT c AS source_column, string_agg(v, '|' ORDER BY source_row) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY source_row) AS rn FROM (SELECT source_row, unnest({_COLS}) AS c, unnest([{', '.join(_COLS)}]) AS v FROM {_HEAD}) WHERE v <> '') WHERE rn <= 3 GROUP BY c""")
def column_samples(src):
    sampled = columns.column_samples(src("people"), "source_row", _COLS)
    return sampled.select("source_column", F.array_join("samples", "|").alias("samples"))


_HEADERS = "concat(CASE l_linenumber WHEN 1 THEN 'Full Name' WHEN 2 THEN 'E-mail 1 - Value' WHEN 3 THEN 'LinkedIn URL' WHEN 4 THEN 'Job Title' WHEN 5 THEN 'Phone' WHEN 6 THEN 'Notes' ELSE 'Deal Stage' END, CASE WHEN l_returnflag = 'A' THEN '' ELSE concat(' ', l_returnflag, l_linestatus) END)"
_TYPES = " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{k}'" for p, k in columns.COLUMN_PATTERNS)


@query("column_name_types", f"""
SELECT h AS header, cast(count(*) AS bigint) AS n, CASE {_TYPES} END AS kind,
 CASE WHEN (CASE {_TYPES} END) LIKE 'identity_%' THEN substr(CASE {_TYPES} END, 10) ELSE coalesce(nullif(trim(regexp_replace(lower(trim(h)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'field') END AS target
FROM (SELECT {_HEADERS} AS h FROM lineitem) GROUP BY h""")
def column_name_types(src):
    headers = src.sql(f"SELECT {_HEADERS} AS header FROM lineitem").groupBy("header").agg(F.count("*").alias("n"))
    kind = columns.name_type(F.col("header"))
    return headers.withColumn("kind", kind).withColumn("target", columns.target_name(F.col("header"), F.coalesce("kind", F.lit(""))))


@query("column_value_types", f"""
WITH s AS (SELECT dataset_id AS d, c, v FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, c ORDER BY source_row) AS rn FROM (SELECT dataset_id, source_row, unnest({_COLS}) AS c, unnest([{', '.join(_COLS)}]) AS v FROM people) WHERE v <> '') WHERE rn <= 3),
g AS (SELECT concat(d, '.', c) AS source_column, bool_and(length(v) BETWEEN 2 AND 80 AND regexp_full_match(regexp_replace(v, '[.\\-'',()]', '', 'g'), '[\\p{{L}}\\s]*') AND len(string_split_regex(trim(v), '\\s+')) <= 6 AND regexp_matches(v, '(^|\\s)[A-Z]')) AS nm,
  bool_and(regexp_matches(v, '^[^@]+@[^@]+\\.[^@]+')) AS em, bool_and(contains(lower(v), 'linkedin.com')) AS li, bool_and(regexp_matches(v, '^https?://')) AS ur, bool_and(regexp_matches(lower(v), 'twitter\\.com|x\\.com')) AS tw, bool_and(regexp_matches(lower(v), 'drive\\.google\\.com|docs\\.google\\.com|dropbox\\.com')) AS rs, avg(length(v)) AS ml FROM s GROUP BY 1)
SELECT source_column, CASE WHEN nm THEN 'identity_name' WHEN em THEN 'identity_email' WHEN li THEN 'identity_linkedin' WHEN ur AND tw THEN 'link_twitter' WHEN ur AND rs THEN 'link_resume' WHEN ur THEN 'link_website' WHEN ml < 30 THEN 'metadata' ELSE 'metadata' END AS kind,
 CASE WHEN nm THEN 0.7::double WHEN em OR li THEN 0.8 WHEN ur AND tw THEN 0.8 WHEN ur AND rs THEN 0.7 WHEN ur THEN 0.5 WHEN ml < 30 THEN 0.5 ELSE 0.3 END AS confidence FROM g""")
def column_value_types(src):
    cells = src("people").unpivot(["dataset_id", "source_row"], _COLS, "c", "value").where("value <> ''")
    top = keyed.top_per_key(cells, ["dataset_id", "c"], [F.asc("source_row")], 3)
    samples = top.groupBy(F.concat("dataset_id", F.lit("."), "c").alias("source_column")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples"))
    return columns.value_type(columns.describe_samples(samples)).select("source_column", "kind", "confidence")


@query("column_profile", """
SELECT c AS source_column, round(count(*) FILTER (v <> '') / count(*)::double, 6) AS fill_rate, round(coalesce(avg(length(v)) FILTER (v <> ''), 0), 6) AS mean_length,
 round(count(*) FILTER (regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) / count(*)::double, 6) AS email_share, round(count(*) FILTER (regexp_matches(v, '^https?://')) / count(*)::double, 6) AS url_share, cast(0 AS double) AS number_share
FROM (SELECT unnest(%s) AS c, unnest([%s]) AS v FROM people) GROUP BY c""" % (_COLS, ", ".join(_COLS)))
def column_profile(src):
    return columns.profile_columns(src("people"), _COLS).drop("approx_distinct")


# --- intake -----------------------------------------------------------------------------------
def _mapped(src):
    pick = columns.FieldMapping
    upload = src("people").select("source_row", F.col("name").alias("Full Name"), F.split_part("name", F.lit(" "), F.lit(1)).alias("First"),
                                  "email", F.col("organization").alias("Org"), F.col("country").alias("Alt Org"),
                                  F.when(F.col("twitter_url") != "", F.concat(F.lit("@u"), F.col("source_row").cast("string"))).otherwise("NA").alias("X"),
                                  F.col("linkedin_url").alias("LI"), F.col("title").alias("Bio"), F.col("dataset_id").alias("Tag"))
    kinds = [("First", "identity_name", "name"), ("Full Name", "identity_name", "name"), ("email", "identity_email", "email"), ("Org", "identity_org", "org"),
             ("Alt Org", "identity_org", "org"), ("X", "link_twitter", "x"), ("LI", "identity_linkedin", "linkedin"), ("Bio", "content", "bio"), ("Tag", "metadata", "tag")]
    return intake.rows_to_profiles(upload, [pick(c, k, t, (), 0.9) for c, k, t in kinds])


@query("profiles_from_rows", """
SELECT source_row, CASE WHEN name = '' THEN '' ELSE name END AS name, trim(email) AS email, country AS organization, CASE WHEN twitter_url <> '' THEN concat('https://twitter.com/u', source_row) ELSE '' END AS twitter_url, linkedin_url,
 CASE WHEN linkedin_url <> '' THEN 'user' ELSE '' END AS linkedin_url_source, CASE WHEN title <> '' THEN concat('bio=', title) ELSE '' END AS content, concat('tag=', dataset_id) AS metadata FROM people""")
def profiles_from_rows(src):
    flat = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _mapped(src).select(
        "source_row", "name", "email", "organization", "twitter_url", "linkedin_url", "linkedin_url_source",
        flat("content_fields").alias("content"), flat("metadata").alias("metadata"))


@query("junk_rows_dropped", "SELECT source_row FROM people WHERE name <> '' OR email <> '' OR linkedin_url <> '' OR title <> ''")
def junk_rows_dropped(src):
    return intake.drop_junk(_mapped(src)).select("source_row")


@query("junk_row_counts", "SELECT cast(count(*) AS bigint) AS rows, cast(count(*) FILTER (name = '' AND email = '' AND linkedin_url = '' AND title = '') AS bigint) AS skipped_rows FROM people")
def junk_row_counts(src):
    return intake.junk_count(_mapped(src))


@query("content_field_names", "SELECT 'bio' AS field_name, cast(count(*) AS bigint) AS n_profiles FROM people WHERE title <> ''")
def content_field_names(src):
    return intake.content_field_names(_mapped(src))


@query("upload_summary", _MATCHES + f""",
kept AS (SELECT * FROM people WHERE NOT (name = '' AND email = '' AND linkedin_url = '' AND title = ''))
SELECT cast(count(*) AS bigint) AS total, cast(count(*) FILTER ({VALID.format(u='linkedin_url')}) AS bigint) AS have_url, cast(count(*) FILTER (trim(email) <> '' AND NOT {VALID.format(u='linkedin_url')}) AS bigint) AS email_only,
 cast(max(title <> '') AS bigint) AS content_fields, CASE WHEN max(title <> '') THEN 'bio' ELSE '' END AS content_field_names, (SELECT cast(count(*) AS bigint) FROM people) - cast(count(*) AS bigint) AS skipped_rows, (SELECT cast(count(*) AS bigint) FROM m) AS duplicates FROM kept""")
def upload_summary(src):
    return reports.upload_summary(_mapped(src), dedup.find_duplicates(src("people"), src("known_people")))


# --- upkeep ---------------------------------------------------------------------------------------
@query("work_queues", f"""
SELECT id, q AS queue FROM (SELECT id, unnest([CASE WHEN linkedin_url = '' AND name <> '' THEN 'resolve' END, CASE WHEN linkedin_url <> '' AND name <> '' AND website_url = '' AND twitter_url = '' THEN 'evidence_only' END, CASE WHEN {VALID.format(u='linkedin_url')} THEN 'enrich' END,
 CASE WHEN linkedin_url <> '' AND NOT {VALID.format(u='linkedin_url')} THEN 'reroute' END]) AS q FROM people WHERE enrichment_status = 'pending') WHERE q IS NOT NULL""")
def work_queues(src):
    return upkeep.work_queues(src("people"))


def _stored(src):
    links = F.filter(F.split("other_links_csv", ","), lambda u: u != "")
    return src("stored_people").withColumn("other_links", links)


@query("profiles_to_fetch", """
SELECT id FROM stored_people WHERE concat(twitter_url, website_url, resume_url, other_links_csv) <> '' AND fetched_content IN ('', '{}')""")
def profiles_to_fetch(src):
    return upkeep.needs_fetch(_stored(src)).select("id")


@query("stored_profiles_to_fetch", """
SELECT id FROM stored_people WHERE concat(twitter_url, website_url, resume_url) <> '' AND fetched_content IN ('', '{}')""")
def stored_profiles_to_fetch(src):
    return upkeep.needs_fetch(store.conform(src("stored_people"))).select("id")


@query("stored_people_reset", """
SELECT id, 'pending' AS enrichment_status, '' AS linkedin_enriched, '' AS profile_card, 0 AS n_summaries, 0 AS n_fetched, linkedin_url FROM stored_people""")
def stored_people_reset(src):
    reset = upkeep.reset_for_rerun(store.conform(src("stored_people")))
    return store.conform(reset).select(
        "id", "enrichment_status", "linkedin_enriched", "profile_card", F.size("field_summaries").alias("n_summaries"),
        F.size("fetched_content").alias("n_fetched"), "linkedin_url")


@query("active_searches", "SELECT o_orderkey AS search_id FROM orders WHERE o_orderstatus <> 'F'")
def active_searches(src):
    searches = src("orders").select(F.col("o_orderkey").alias("search_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("archived_at"))
    return upkeep.active(searches).select("search_id")


@query("toggled_archive", """
SELECT o_orderkey AS search_id, CASE WHEN o_orderkey IN (SELECT s_suppkey FROM supplier) THEN CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'now' END WHEN o_orderstatus = 'F' THEN 'old' END AS archived_at FROM orders""")
def toggled_archive(src):
    searches = src("orders").select(F.col("o_orderkey").alias("search_id"), F.when(F.col("o_orderstatus") == "F", "old").alias("archived_at"))
    return upkeep.toggle_archived(searches, src("supplier").select(F.col("s_suppkey").alias("search_id")), F.lit("now"))


@query("version_stamps", """
SELECT id, CASE WHEN enrichment_status <> 'pending' AND enrichment_version = '' THEN 'v0-legacy' ELSE enrichment_version END AS enrichment_version,
 CASE WHEN linkedin_url <> '' AND linkedin_url_source = '' THEN 'resolved' ELSE linkedin_url_source END AS linkedin_url_source FROM people""")
def version_stamps(src):
    return upkeep.fill_url_source(upkeep.stamp_version(src("people"))).select("id", "enrichment_version", "linkedin_url_source")


@query("display_columns", """
SELECT id, coalesce(nullif(full_name, ''), nullif(name, ''), nullif(email, ''), 'Unknown') AS display_name, trim(coalesce(nullif(organization, ''), current_company)) AS employer, trim(coalesce(nullif(title, ''), current_title)) AS job_title, trim(location) AS place,
 coalesce(nullif(upper(list_aggregate(list_transform(list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '')[1:2], lambda x: x[1]), 'string_agg', '')), ''), '?') AS initials FROM people JOIN vendor ON profile_id = id""")
def display_columns(src):
    return upkeep.display_columns(src("people"), src("vendor"))


@query("gallery", "SELECT id, name, linkedin_url <> '' AS found FROM people")
def gallery(src):
    return upkeep.gallery(src("people"))


@query("searchable_text", """
SELECT profile_id, CASE doc % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN concat('fetched_', field_name) ELSE field_name END AS field_name, md5(trim(body, ' ' || chr(9) || chr(10) || chr(13))) AS body_md5 FROM (SELECT *, profile_id AS doc FROM notes) WHERE trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def searchable_text(src):
    origin = F.when(F.col("profile_id") % 3 == 0, "vendor").when(F.col("profile_id") % 3 == 1, "fetched").otherwise("content")
    found = upkeep.searchable_text(src("notes").withColumn("origin", origin))
    return found.select("profile_id", "field_name", F.md5("body").alias("body_md5"))


@query("raw_text", """
SELECT p.id, substr(coalesce(nullif(CASE WHEN p.source_row % 4 = 0 THEN d.text ELSE '' END, ''), nullif(concat_ws(chr(10), nullif(CASE WHEN p.source_row % 4 = 1 THEN d.text ELSE '' END, ''), nullif(p.title, '')), ''), concat_ws(chr(10), CASE WHEN length(p.name) > 2 THEN p.name END, CASE WHEN length(p.country) > 2 THEN p.country END)), 1, 3000) AS raw_text
FROM people p LEFT JOIN documents d ON d.doc_id = p.source_row""")
def raw_text(src):
    docs = src("documents").select(F.col("doc_id").alias("source_row"), "text")
    row = F.col("source_row")
    value = upkeep.raw_text(F.when(row % 4 == 0, F.col("text")), F.when(row % 4 == 1, F.col("text")), F.col("title"), [F.col("name"), F.col("country")])
    return src("people").join(docs, "source_row", "left").select("id", value.alias("raw_text"))


@query("misplaced_urls", f"""
WITH t AS (SELECT *, enrichment_status = 'pending' AND NOT {VALID.format(u='linkedin_url')} AND linkedin_url LIKE 'http%' AS stray FROM people)
SELECT id, CASE WHEN stray THEN '' ELSE linkedin_url END AS linkedin_url, CASE WHEN stray THEN linkedin_url ELSE '' END AS resume_url, website_url FROM t""")
def misplaced_urls(src):
    return upkeep.route_misplaced(src("people")).select("id", "linkedin_url", "resume_url", "website_url")


# Landed pages stand for what was fetched from sites and code hosts.
@query("settled_urls", f"""
WITH s AS (SELECT *, CASE WHEN linkedin_url <> '' THEN linkedin_url WHEN source_row % 5 = 1 THEN concat('https://github.com/u', source_row) WHEN source_row % 5 = 2 THEN concat('http://site', source_row % 50, '.example.org/') ELSE '' END AS u,
  coalesce(json_extract_string(nullif(fetched_content, ''), '$.website'), '') AS had FROM stored_people),
f AS (SELECT CASE WHEN page_id % 2 = 0 THEN concat('https://github.com/u', page_id) ELSE concat('http://site', page_id % 50, '.example.org/') END AS url, CASE WHEN page_id % 2 = 0 THEN 'github' ELSE 'website' END AS source, min(concat('page ', url)) AS body FROM pages GROUP BY 1, 2),
t AS (SELECT s.*, enrichment_status = 'pending' AND NOT {VALID.format(u='u')} AS op, enrichment_status = 'pending' AND NOT {VALID.format(u='u')} AND u LIKE 'http%' AS stray FROM s),
j AS (SELECT t.*, f.source, f.body FROM t LEFT JOIN f ON t.stray AND f.url = t.u)
SELECT id, CASE WHEN stray THEN '' ELSE u END AS linkedin_url, CASE WHEN stray AND contains(u, 'drive.google.com') AND resume_url = '' THEN u ELSE resume_url END AS resume_url,
 CASE WHEN stray AND NOT contains(u, 'drive.google.com') AND NOT contains(u, 'github.com') AND website_url = '' THEN u ELSE website_url END AS website_url, CASE WHEN stray AND contains(u, 'github.com') THEN u ELSE '' END AS other_links,
 CASE WHEN NOT op THEN enrichment_status WHEN had <> '' OR source IS NOT NULL THEN 'enriched' ELSE 'skipped' END AS enrichment_status, CASE WHEN source = 'website' THEN body ELSE had END AS website_text, CASE WHEN source = 'github' THEN body ELSE '' END AS code_text,
 concat_ws('|', CASE WHEN source IS NOT NULL THEN concat('Non-LinkedIn URL fetched as ', source, ': ', substr(u, 1, 60)) END, CASE WHEN op AND (had <> '' OR source IS NOT NULL) THEN 'Enriched from non-LinkedIn URL content' END) AS log FROM j""")
def settled_urls(src):
    row = F.col("source_row")
    stray = F.when(F.col("linkedin_url") != "", F.col("linkedin_url")).when(row % 5 == 1, F.concat(F.lit("https://github.com/u"), row.cast("string"))).when(
        row % 5 == 2, F.concat(F.lit("http://site"), (row % 50).cast("string"), F.lit(".example.org/"))).otherwise("")
    code, page = F.col("page_id") % 2 == 0, F.col("page_id")
    fetched = src("pages").select(
        F.when(code, F.concat(F.lit("https://github.com/u"), page.cast("string"))).otherwise(F.concat(F.lit("http://site"), (page % 50).cast("string"), F.lit(".example.org/"))).alias("url"),
        F.when(code, "github").otherwise("website").alias("source"), F.concat(F.lit("page "), "url").alias("body"))
    rows = upkeep.settle_misplaced(store.conform(src("stored_people").withColumn("linkedin_url", stray)), fetched)
    said = lambda k: F.coalesce(F.get(F.map_values(F.map_filter("fetched_content", lambda name, _: name == k)), 0), F.lit(""))
    return rows.select(
        "id", "linkedin_url", "resume_url", "website_url", F.array_join(F.coalesce("other_links", F.array()), "|").alias("other_links"), "enrichment_status",
        said("website").alias("website_text"), said("github").alias("code_text"), F.array_join("enrichment_log", "|").alias("log"))


@query("review_buckets", """
SELECT CASE WHEN linkedin_url = '' THEN 'missing' WHEN linkedin_url_source = 'user' THEN 'confirmed' ELSE 'review' END AS bucket, cast(count(*) AS bigint) AS n FROM people GROUP BY 1""")
def review_buckets(src):
    return upkeep.review_buckets(src("people"))


@query("legacy_scope", """
SELECT id FROM people JOIN vendor ON profile_id = id WHERE (enrichment_version = 'v0-legacy' AND enrichment_status = 'enriched') OR (enrichment_status IN ('failed', 'skipped') AND ((current_company <> '' AND current_company = trim(organization)) OR (current_title <> '' AND current_title = trim(title))))""")
def legacy_scope(src):
    return upkeep.legacy_scope(src("people"), src("vendor")).select("id")


@query("trimmed_logs", """
WITH t AS (SELECT *, count(*) OVER (PARTITION BY profile_id) AS n, row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY profile_id ORDER BY pos DESC) AS z FROM log_lines)
SELECT profile_id, pos, line, CASE WHEN n <= 20 THEN 'kept' WHEN a <= 5 THEN 'head' ELSE 'tail' END AS part FROM t WHERE n <= 20 OR a <= 5 OR z <= 5 UNION ALL SELECT profile_id, pos, '... truncated ...', 'marker' FROM t WHERE n > 20 AND a = 5""")
def trimmed_logs(src):
    return upkeep.trim_logs(src("log_lines"))


@query("reset_people", """
SELECT id, name, 'pending' AS enrichment_status, enrichment_version, linkedin_url, linkedin_url_source, photo_path, '' AS linkedin_enriched, '' AS profile_card, '' AS field_summaries, '' AS fetched_content FROM stored_people""")
def reset_people(src):
    return upkeep.reset_for_rerun(src("stored_people")).select(
        "id", "name", "enrichment_status", "enrichment_version", "linkedin_url", "linkedin_url_source", "photo_path", *upkeep.DERIVED)


@query("pending_skipped", "SELECT id, CASE WHEN enrichment_status = 'pending' THEN 'skipped' ELSE enrichment_status END AS enrichment_status FROM people")
def pending_skipped(src):
    return upkeep.skip_pending(src("people")).select("id", "enrichment_status")


@query("manual_corrections", """
WITH c AS (SELECT concat('p', o_custkey) AS pid, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('https://www.linkedin.com/in/n', o_custkey % 50, '/') END, o_orderkey) AS u FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT id, coalesce(u, linkedin_url) AS linkedin_url, linkedin_url_source, CASE WHEN u = '' THEN 'failed' WHEN u IS NOT NULL THEN 'enriched' ELSE enrichment_status END AS enrichment_status,
 CASE WHEN u <> '' AND name = '' AND s_name IS NOT NULL THEN s_name ELSE name END AS name, CASE WHEN u = '' THEN '' WHEN s_name IS NOT NULL THEN concat('jobs of ', s_name) ELSE linkedin_enriched END AS linkedin_enriched,
 CASE WHEN u = '' THEN '' ELSE profile_card END AS profile_card, CASE WHEN u IS NOT NULL THEN '' ELSE photo_path END AS photo_path,
 CASE WHEN u = '' THEN 'LinkedIn manually cleared by user' WHEN u IS NULL THEN '' WHEN s_name IS NOT NULL THEN concat('LinkedIn manually set to: ', u, '|LinkedIn enriched (manual): ', s_nationkey, ' experiences') ELSE concat('LinkedIn manually set to: ', u, '|LinkedIn set but no vendor data') END AS new_log_lines
FROM stored_people LEFT JOIN c ON pid = id LEFT JOIN supplier ON rtrim(u, '/') = concat('https://www.linkedin.com/in/n', s_suppkey)""")
def manual_corrections(src):
    row = F.col("o_orderkey")
    given = src("orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("profile_id"), row.alias("pos"),
        F.when(row % 3 == 0, "").otherwise(F.concat(F.lit("https://www.linkedin.com/in/n"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"))).alias("new_url"))
    landed = src("supplier").select(
        F.concat(F.lit("http://www.linkedin.com/in/n"), F.col("s_suppkey").cast("string")).alias("url"), F.col("s_name").alias("full_name"),
        F.col("s_nationkey").alias("n_jobs"), F.concat(F.lit("jobs of "), "s_name").alias("payload"))
    return upkeep.apply_corrections(src("stored_people"), given, landed).select(
        "id", "linkedin_url", "linkedin_url_source", "enrichment_status", "name", "linkedin_enriched", "profile_card", "photo_path",
        F.array_join("new_log_lines", "|").alias("new_log_lines"))


# --- cards ------------------------------------------------------------------------------------------
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_TIERS = " ".join(f"WHEN regexp_matches(field_name, '{p}') THEN '{t}'" for p, t in columns.FIELD_TIERS)
_LABEL = "CASE field_name WHEN 'call_notes' THEN 'Call Notes' WHEN 'assessment' THEN 'Assessment' WHEN 'linkedin_text' THEN 'Linkedin Text' WHEN 'bio' THEN 'Bio' WHEN 'other' THEN 'Other' WHEN 'goals' THEN 'Goals' ELSE 'Pitch' END"
_SUM = f"""ft AS (SELECT *, {_STRIP.format('body')} AS b, CASE {_TIERS} WHEN length(body) > 1500 THEN 'self_reported' ELSE 'first_person' END AS tier, {_LABEL} AS label FROM fields WHERE {_STRIP.format('body')} <> ''),
fc AS (SELECT *, substr(b, 1, 600) AS h, length(substr(b, 1, 600)) - strpos(reverse(substr(b, 1, 600)), '.') + 1 AS dot, {_STRIP.format("split_part(b, '.', 1)")} AS fs, string_split(b, chr(10)) AS ls FROM ft),
fl AS (SELECT *, {_STRIP.format("array_to_string(ls[1:5], chr(10))")} AS ll FROM fc),
fsum AS (SELECT *, CASE WHEN length(b) <= 200 THEN b WHEN tier IN ('first_person', 'expert_assessment') THEN CASE WHEN length(b) <= 600 THEN b WHEN contains(h, '.') AND dot - 1 > 360 THEN substr(b, 1, dot) ELSE regexp_replace(h, '\\s+$', '') || '...' END
  WHEN tier = 'linkedin' THEN CASE WHEN length(ll) > 600 THEN regexp_replace(substr(ll, 1, 600), '\\s+$', '') || '...' ELSE ll END ELSE concat(label, ': ', CASE WHEN length(fs) > 120 THEN regexp_replace(substr(fs, 1, 120), '\\s+$', '') || '...' ELSE fs END, '.') END AS summary FROM fl)"""


@query("field_summaries", f"""WITH fields AS (SELECT * FROM notes), {_SUM} SELECT profile_id, field_name, tier, summary FROM fsum""")
def field_summaries(src):
    return cards.field_summaries(src("notes")).select("profile_id", "field_name", "tier", "summary")


@query("profile_cards", f"""WITH fields AS (SELECT profile_id, field_name, body, 0 AS place FROM notes UNION ALL SELECT source_row, 'goals', concat('Wants to meet people in ', country, '. Soon.'), 1 FROM people), {_SUM},
pr AS (SELECT profile_id, place, CASE tier WHEN 'first_person' THEN 0 WHEN 'expert_assessment' THEN 1 WHEN 'linkedin' THEN 2 ELSE 3 END AS rk, chr(10) || CASE WHEN starts_with(lower(summary), lower(label)) THEN summary ELSE concat(label, ': ', summary) END AS s FROM fsum)
SELECT p.id, {_STRIP.format("concat_ws(chr(10), concat_ws(' | ', coalesce(nullif(name, ''), 'Unknown'), CASE WHEN title <> '' AND organization <> '' THEN concat(title, ' at ', organization) WHEN title <> '' THEN title WHEN organization <> '' THEN organization END), CASE WHEN v.current_title <> '' THEN concat(chr(10), 'Headline: ', v.current_title) END, (SELECT string_agg(s, chr(10) ORDER BY rk, place) FROM pr WHERE pr.profile_id = p.source_row))")} AS profile_card
FROM people p LEFT JOIN vendor v ON v.profile_id = p.id""")
def profile_cards(src):
    vendor = src("vendor").select(F.col("profile_id").alias("id"), F.when(F.col("current_title") != "", F.concat(F.lit("Headline: "), F.col("current_title"))).otherwise("").alias("vendor_text"))
    notes = src("notes").select(F.col("profile_id").alias("source_row"), "field_name", "body")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    goals = F.concat(F.lit("Wants to meet people in "), F.col("country"), F.lit(". Soon."))
    own = F.when(F.col("field_name").isNotNull(), F.array(entry(F.col("field_name"), F.col("body")))).otherwise(
        F.array().cast("array<struct<key: string, value: string>>"))
    people = src("people").join(vendor, "id", "left").join(notes, "source_row", "left").withColumn(
        "content_fields", F.concat(own, F.array(entry(F.lit("goals"), goals)))).withColumn("vendor_text", F.coalesce("vendor_text", F.lit("")))
    return cards.build_cards(people)


@query("link_requests", """
SELECT id AS profile_id, 'twitter' AS slot, twitter_url AS url, 'twitter' AS kind FROM people WHERE twitter_url <> '' UNION ALL SELECT id, 'website', website_url, 'website' FROM people WHERE website_url <> ''
UNION ALL SELECT id, 'link_0', concat('https://github.com/u', source_row), 'github' FROM people""")
def link_requests(src):
    people = src("people").withColumn("other_links", F.array(F.concat(F.lit("https://github.com/u"), F.col("source_row").cast("string"))))
    return cards.link_requests(people)


@query("fetched_texts", f"""
WITH t AS (SELECT rtrim(lower(url), '/') AS k, {_ARTICLE} AS body FROM pages),
u AS (SELECT k, body, list_filter(list_transform(string_split(body, '. '), lambda x: trim(x)), lambda x: length(x) > 20 AND length(x) < 500 AND NOT regexp_matches(x, '^(Cookie|Privacy|Terms|Copyright|©)')) AS s FROM t),
v AS (SELECT k, min(bio) AS bio FROM (SELECT k, substr(CASE WHEN len(s) > 0 THEN concat(array_to_string(s[1:10], '. '), '.') ELSE body END, 1, 2000) AS bio FROM u) WHERE length(bio) >= 50 GROUP BY k)
SELECT page_id AS profile_id, md5(coalesce(bio, '')) AS body_md5 FROM pages LEFT JOIN v ON k = rtrim(lower(url), '/')""")
def fetched_texts(src):
    requests = src("pages").select(F.col("page_id").alias("profile_id"), "url")
    return cards.fetched_text(requests, src("pages")).select("profile_id", F.md5("body").alias("body_md5"))


@query("social_bios", r"""
WITH t AS (SELECT profile_id, pos, url, title, description, CASE WHEN regexp_matches(rtrim(lower(url), '/'), concat('/', lower(h), '$')) AND regexp_matches(lower(url), 'x\.com|twitter\.com') THEN 0 WHEN contains(lower(url), lower(h)) THEN 1 END AS turn
  FROM (SELECT w.*, replace(split_part(p.name, ',', 1), ' ', '') AS h FROM web_results w JOIN people p ON p.id = w.profile_id WHERE p.name <> ''))
SELECT profile_id, concat_ws(chr(10), concat('X/Twitter: ', arg_min(title, (turn, pos))), concat('Bio: ', arg_min(description, (turn, pos)))) AS body FROM t WHERE turn IS NOT NULL GROUP BY profile_id""")
def social_bios(src):
    handles = src("people").where("name <> ''").select(F.col("id").alias("profile_id"), F.replace(F.split_part("name", F.lit(","), F.lit(1)), F.lit(" "), F.lit("")).alias("handle"))
    return cards.social_bio(src("web_results").join(handles, "profile_id"))


@query("code_bios", """
SELECT id AS profile_id, concat('GitHub: ', name, chr(10), CASE WHEN organization <> '' THEN concat('Company: ', organization, chr(10)) ELSE '' END, 'Repos:', chr(10), '  alpha — work on ', country, ' (', source_row % 7 + 1, ' stars) [Go]', chr(10), '  beta') AS body FROM people WHERE name <> ''""")
def code_bios(src):
    lit = F.lit
    row = (F.col("source_row") % 7 + 1).cast("int")
    repos = F.array(
        F.struct(lit("alpha").alias("name"), F.concat(lit("work on "), F.col("country")).alias("description"), row.alias("stargazers_count"), lit("Go").alias("language")),
        F.struct(lit("beta").alias("name"), lit("").alias("description"), lit(0).alias("stargazers_count"), lit("").alias("language")))
    user = F.to_json(F.struct("name", F.col("organization").alias("company"), repos.alias("repos")))
    return cards.code_bio(src("people").where("name <> ''").select(F.col("id").alias("profile_id"), user.alias("body")))


# --- files of uploads --------------------------------------------------------------------------
def _folder(src):
    return f"{checkpoint_dir(src.spark)}/rollcall-{uuid.uuid4().hex}"


_AS_TEXT = "SELECT cast(c_custkey AS varchar) AS c_custkey, c_name, cast(c_nationkey AS varchar) AS c_nationkey, c_mktsegment || ', \"x\"' AS note FROM customer"


def _upload(src):
    return src("customer").select("c_custkey", "c_name", "c_nationkey", F.concat("c_mktsegment", F.lit(', "x"')).alias("note"))


@query("csv_upload_rows", _AS_TEXT)
def csv_upload_rows(src):
    folder = _folder(src)
    sinks.write_csv(_upload(src), folder)
    return uploads.read_csv(src.spark, folder, multi_line=False)


@query("json_upload_rows", _AS_TEXT)
def json_upload_rows(src):
    folder = _folder(src)
    _upload(src).write.json(folder)
    return uploads.read_json(src.spark, folder, multi_line=False).select("c_custkey", "c_name", "c_nationkey", "note")


@query("csv_line_rows", _AS_TEXT)
def csv_line_rows(src):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    columns = ["c_custkey", "c_name", "c_nationkey", "note"]
    return uploads.parse_csv_lines(_upload(src).select(F.concat_ws(",", *[quoted(c) for c in columns]).alias("value")), columns)


@query("upload_identities", """
SELECT lower(c_name) || '@example.org' AS email, 'Customer ' || c_custkey AS name, c_mktsegment AS organization, 'nation ' || c_nationkey AS title FROM customer""")
def upload_identities(src):
    upload = src("customer").select(
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("E-mail Address"), F.lit("Customer").alias("First Name"), F.col("c_custkey").cast("string").alias("Surname"),
        F.concat(F.lit(" "), "c_mktsegment").alias("Company"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("Job Title"))
    return uploads.source_rows(upload).select("email", "name", "organization", "title")


@query("ground_truth_rows", """
SELECT id AS profile_id, name AS uploaded_name, email, CASE WHEN linkedin_url = '' THEN '' ELSE rtrim(lower(linkedin_url), '/') END AS true_linkedin_url, rtrim(lower(website_url), '/') AS true_website_url, '' AS true_twitter_url, source_row % 5 = 0 AS true_is_hidden, 'n' AS notes FROM people""")
def ground_truth_rows(src):
    folder = _folder(src)
    sheet = src("people").select(
        F.concat(F.lit(" "), "id").alias("profile_id"), F.col("name").alias("uploaded_name"), "email", F.col("linkedin_url").alias("true_linkedin_url"),
        F.col("website_url").alias("true_website_url"), F.lit("").alias("true_twitter_url"), F.when(F.col("source_row") % 5 == 0, " Yes").otherwise("no").alias("true_is_hidden"), F.lit("n").alias("notes"))
    blank = sheet.select(F.lit("  ").alias("profile_id"), *sheet.columns[1:])
    sinks.write_csv(sheet.unionByName(blank), folder)
    return uploads.read_ground_truth(src.spark, folder)


@query("upload_preview_counts", "SELECT count(*) AS row_count FROM customer")
def upload_preview_counts(src):
    return uploads.row_count(_upload(src))
