"""Views that give every operator data, derived from the whole of the given tables.

The text of each view runs unchanged in Spark SQL and in ANSI engines, so the same
definition feeds an operator and the SQL that checks it. No view drops rows by id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["people"] = """
SELECT concat('p', cast(c.c_custkey AS string)) AS id,
       concat('d', cast(c.c_custkey % 4 AS string)) AS dataset_id,
       concat('a', cast(c.c_custkey % 3 AS string)) AS account_id,
       cast(c.c_custkey AS bigint) AS source_row,
       CASE WHEN c.c_custkey % 23 = 0 THEN '' WHEN c.c_custkey % 11 = 0 THEN split_part(pt.p_name, ' ', 1)
            WHEN c.c_custkey % 13 = 0 THEN concat(replace(pt.p_name, ' ', ' M '), ', Ph.D.')
            ELSE pt.p_name END AS name,
       CASE WHEN c.c_nationkey % 7 = 6 THEN '' WHEN c.c_custkey % 97 = 0 THEN 'no-at-sign'
            ELSE concat(replace(pt.p_name, ' ', '.'), cast(c.c_custkey % 40 AS string), '@',
                 CASE c.c_nationkey % 7 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'uni.edu' WHEN 2 THEN 'agency.gov'
                      WHEN 3 THEN 'charity.org' WHEN 4 THEN 'acme.com' ELSE 'college.ac.uk' END) END AS email,
       CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE concat(c.c_mktsegment, ' Inc') END AS organization,
       CASE WHEN c.c_custkey % 6 = 0 THEN '' ELSE concat(pt.p_type, ' Lead') END AS title,
       CASE WHEN c.c_custkey % 3 = 0 THEN concat('https://www.linkedin.com/in/', replace(pt.p_name, ' ', '-'), '/')
            WHEN c.c_custkey % 17 = 0 THEN 'https://drive.google.com/file/d/abc/view' ELSE '' END AS linkedin_url,
       CASE WHEN c.c_custkey % 3 = 0 AND c.c_custkey % 2 = 0 THEN 'user' WHEN c.c_custkey % 3 = 0 THEN 'resolved' ELSE '' END AS linkedin_url_source,
       CASE WHEN c.c_custkey % 9 = 0 THEN concat('https://x.com/u', cast(c.c_custkey AS string)) ELSE '' END AS twitter_url,
       CASE WHEN c.c_custkey % 8 = 0 THEN concat('https://site', cast(c.c_custkey % 50 AS string), '.example.org/about') ELSE '' END AS website_url,
       CASE WHEN c.c_acctbal < 0 THEN 'failed' WHEN c.c_acctbal < 2000 THEN 'skipped'
            WHEN c.c_acctbal < 8000 THEN 'enriched' ELSE 'pending' END AS enrichment_status,
       CASE WHEN c.c_custkey % 4 = 0 THEN '' WHEN c.c_custkey % 4 = 1 THEN 'v0-legacy' ELSE 'v1' END AS enrichment_version,
       n.n_name AS country
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part pt ON pt.p_partkey = c.c_custkey
"""

VIEWS["raw_fields"] = """
SELECT c.c_custkey AS row_id,
       CASE c.c_custkey % 6 WHEN 0 THEN concat('Dr. ', initcap_name) WHEN 1 THEN concat(initcap_name, ', Ph.D., M.D.')
            WHEN 2 THEN upper(initcap_name) WHEN 3 THEN concat('José  ', initcap_name, ' (Saba)')
            WHEN 4 THEN concat(initcap_name, ' Jr.') ELSE concat('  Zoë-Anne ', initcap_name, ' ') END AS raw_name,
       CASE c.c_custkey % 5 WHEN 0 THEN concat('The ', c.c_mktsegment, ' Company') WHEN 1 THEN concat(c.c_mktsegment, ', Inc.')
            WHEN 2 THEN concat(c.c_mktsegment, ' & Sons LLC') WHEN 3 THEN '' ELSE lower(c.c_mktsegment) END AS raw_org,
       CASE c.c_custkey % 7 WHEN 0 THEN concat('https://www.linkedin.com/in/', slug, '/https://x.com/', slug, '/')
            WHEN 1 THEN concat('linkedin.com/in/', slug, ' https://blog.example.org/') WHEN 2 THEN 'N/A'
            WHEN 3 THEN concat('www.linkedin.com/in/', slug, ',x.com/', slug) WHEN 4 THEN concat('@', slug)
            WHEN 5 THEN concat('HTTP://uk.linkedin.com/in/', slug, '/?trk=a#top') ELSE concat('https://github.com/', slug, '/repo') END AS raw_link,
       CASE c.c_custkey % 6 WHEN 0 THEN concat('http://www.linkedin.com/in/', slug, '/') WHEN 1 THEN concat('https://www.linkedin.com/in/', slug, '?a=1/')
            WHEN 2 THEN 'https://www.linkedin.com/feed/' WHEN 3 THEN concat('https://twitter.com/', slug, '/status/9')
            WHEN 4 THEN concat('https://docs.google.com/document/d/', slug, '/edit?id=zz') ELSE concat('https://x.com/home?u=', slug) END AS url
FROM (SELECT cc.*, concat(upper(substr(pt.p_name, 1, 1)), substr(split_part(pt.p_name, ' ', 1), 2), ' ', upper(substr(split_part(pt.p_name, ' ', 2), 1, 1)), substr(split_part(pt.p_name, ' ', 2), 2)) AS initcap_name,
             replace(pt.p_name, ' ', '-') AS slug
      FROM customer cc JOIN part pt ON pt.p_partkey = cc.c_custkey) c
"""

VIEWS["stored_people"] = """
SELECT p.*, CASE WHEN source_row % 9 = 0 THEN concat('https://docs.google.com/d/', id) ELSE '' END AS resume_url,
       CASE WHEN source_row % 8 = 1 THEN concat('https://example.org/o/', id) ELSE '' END AS other_links_csv,
       CASE source_row % 4 WHEN 0 THEN concat('{"website": "', country, '"}') WHEN 1 THEN '{}' ELSE '' END AS fetched_content,
       CASE WHEN source_row % 2 = 0 THEN concat('{"full_name": "', name, '"}') ELSE '' END AS linkedin_enriched,
       concat('card of ', id) AS profile_card, CASE WHEN source_row % 3 = 0 THEN '{"pitch": "x"}' ELSE '' END AS field_summaries,
       CASE WHEN source_row % 5 = 0 THEN concat('photos/', id) ELSE '' END AS photo_path
FROM people p
"""

VIEWS["log_lines"] = """
SELECT concat('p', cast(user_id AS string)) AS profile_id, event_id AS pos,
       CASE event_type
         WHEN 'view' THEN concat('Trying LinkedIn: https://www.linkedin.com/in/s', cast(event_id % 97 AS string))
         WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN '  Verify location: MATCH (x)' WHEN 1 THEN '  Verify name: MATCH ({b}, strength=weak)'
                                WHEN 2 THEN '  Search (name+org): q' WHEN 3 THEN '  Verify content relevance: WEAK (zero overlap)' ELSE '  Verify org: MATCH (x)' END
         WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN '  Verify org: MISMATCH (x)' WHEN event_id % 9 = 0 THEN '  Verify name: WEAK-MATCH REJECTED (x)'
                                 ELSE '  Verify name: MATCH ({a}, strength=strong)' END
         WHEN 'purchase' THEN CASE WHEN event_id % 6 = 0 THEN '  Verify result: ACCEPTED (score=2, checks=1)'
                                   ELSE '  Verify result: ACCEPTED (score=3, checks=1, name=strong, positives=0, penalties=0)' END
         ELSE CASE WHEN event_id % 5 = 0 THEN '  API returned no data (404_not_found)' WHEN event_id % 7 = 0 THEN 'Ambiguous: 3 candidates tied at score 9'
                   ELSE '  Verify result: REJECTED (score=1, checks=0 - likely wrong person)' END END AS line
FROM events
"""

VIEWS["known_people"] = """
SELECT concat('k', substr(id, 2)) AS id, concat('known', cast(source_row % 3 AS string)) AS dataset_id,
       CASE WHEN source_row % 4 = 3 THEN concat(name, ' jr') ELSE name END AS name,
       CASE WHEN source_row % 2 = 0 THEN upper(email) ELSE '' END AS email,
       CASE source_row % 4 WHEN 0 THEN organization WHEN 1 THEN 'OTHER LLC' WHEN 2 THEN '' ELSE concat(organization, ' Holdings') END AS organization,
       CASE WHEN source_row % 5 = 0 THEN linkedin_url ELSE '' END AS linkedin_url, source_row AS pos
FROM people
"""

VIEWS["candidates"] = """
SELECT concat('p', cast(e.user_id AS string)) AS profile_id, e.event_id AS pos,
       concat('https://www.linkedin.com/in/', replace(pt.p_name, ' ', '-'), CASE WHEN e.event_id % 3 = 0 THEN '' ELSE concat('-', cast(e.event_id % 5 AS string)) END) AS url,
       concat(pt.p_name, ' | ', c.c_mktsegment) AS title, concat('Works at ', c.c_mktsegment, ' Inc, NATION_', cast(c.c_nationkey AS string)) AS description,
       CASE WHEN e.event_type = 'signup' THEN 'exact' WHEN e.event_type = 'error' THEN 'proximity' ELSE '' END AS evidence_type
FROM events e JOIN customer c ON c.c_custkey = (e.user_id + e.event_id % 2) JOIN part pt ON pt.p_partkey = c.c_custkey
"""

VIEWS["evidence"] = """
SELECT concat('p', cast(user_id AS string)) AS profile_id, event_id AS pos,
       concat(CASE WHEN event_id % 2 = 0 THEN 'HTTPS' ELSE 'https' END, '://site', cast(event_id % 9 AS string), '.example.org/u/', cast(user_id AS string), CASE WHEN event_id % 4 = 0 THEN '/?ref=x' ELSE '' END) AS url,
       CASE event_type WHEN 'view' THEN 'org_site' WHEN 'click' THEN 'openalex' WHEN 'signup' THEN 'github' WHEN 'purchase' THEN 'linkedin' ELSE 'open_web' END AS source,
       CASE event_id % 4 WHEN 0 THEN 'bio' WHEN 1 THEN 'twitter' WHEN 2 THEN 'github' ELSE 'website' END AS kind,
       CASE WHEN value < 5 THEN 'name_match' WHEN value < 8 THEN 'name_match,slug_match' WHEN value < 9 THEN 'email_match' ELSE '' END AS anchors_csv,
       concat('snippet ', props) AS snippet, CASE WHEN event_id % 3 = 0 THEN concat('T', cast(event_id % 10 AS string)) ELSE '' END AS title
FROM events
"""

VIEWS["scores"] = """
SELECT concat('s', cast(c_nationkey % 3 AS string)) AS search_id, concat('p', cast(c_custkey AS string)) AS profile_id,
       cast(c_custkey * 37 % 101 AS int) AS score,
       CASE WHEN c_custkey % 4 = 0 THEN 'h0' ELSE 'h1' END AS prompt_hash FROM customer
"""

VIEWS["feedback"] = """
SELECT event_id, concat('s', cast(event_id % 3 AS string)) AS search_id, concat('p', cast(user_id AS string)) AS profile_id,
       CASE event_type WHEN 'purchase' THEN 'strong_yes' WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no' ELSE 'strong_no' END AS rating,
       CASE WHEN value < 10 THEN '' ELSE concat('because ', props) END AS reason, ts AS created_at
FROM events
"""

VIEWS["ground_truth"] = """
SELECT id AS profile_id,
       CASE WHEN source_row % 5 = 0 THEN '' WHEN source_row % 7 = 0 THEN 'https://www.linkedin.com/in/someone-else'
            ELSE concat('https://www.linkedin.com/in/', replace(name, ' ', '-')) END AS true_linkedin_url,
       CASE WHEN source_row % 16 = 0 THEN website_url WHEN source_row % 10 = 0 THEN 'https://other.example.org' ELSE '' END AS true_website_url,
       twitter_url AS true_twitter_url, source_row % 5 = 0 AS true_is_hidden
FROM people
"""

VIEWS["vendor"] = """
SELECT p.id AS profile_id, concat('https://www.linkedin.com/in/', replace(split_part(p.name, ',', 1), ' ', '-')) AS url,
       CASE WHEN p.source_row % 10 = 0 THEN concat(split_part(p.name, ' ', 1), ' Bécquer') WHEN p.source_row % 10 = 1 THEN 'Otto Nobody'
            WHEN p.source_row % 10 = 2 THEN concat(upper(substr(p.name, 1, 1)), substr(p.name, 2), ', MBA') WHEN p.source_row % 10 = 3 THEN ''
            ELSE p.name END AS full_name,
       CASE WHEN p.source_row % 3 = 0 THEN p.organization WHEN p.source_row % 3 = 1 THEN 'Globex Corporation' ELSE '' END AS current_company,
       CASE WHEN p.source_row % 4 = 0 THEN '' ELSE concat('Chief ', p.country) END AS current_title,
       CASE WHEN p.source_row % 3 = 0 THEN concat('Greater ', p.country, ' Area') WHEN p.source_row % 3 = 1 THEN 'Elsewhere' ELSE '' END AS location,
       CASE WHEN p.source_row % 2 = 0 THEN concat(p.organization, ' Group') ELSE '' END AS past_company
FROM people p
"""

VIEWS["verify_pairs"] = """
SELECT p.id AS profile_id, p.name, p.organization, p.linkedin_url_source, p.country, concat('city ', p.dataset_id) AS city, coalesce(d.text, '') AS content_text,
       v.url, v.full_name, split(concat(v.current_company, '#', v.past_company), '#') AS companies, v.location, coalesce(d2.text, '') AS context_block
FROM people p JOIN vendor v ON v.profile_id = p.id LEFT JOIN documents d ON d.doc_id = p.source_row LEFT JOIN documents d2 ON d2.doc_id = p.source_row + 1
"""

VIEWS["notes"] = """
SELECT d.doc_id AS profile_id, CASE d.doc_id % 6 WHEN 0 THEN 'call_notes' WHEN 1 THEN 'assessment' WHEN 2 THEN 'linkedin_text'
            WHEN 3 THEN 'bio' WHEN 4 THEN 'other' ELSE 'pitch' END AS field_name, d.text AS body
FROM documents d
"""

VIEWS["web_results"] = """
SELECT concat('p', cast(e.user_id AS string)) AS profile_id, e.event_id AS pos,
       CASE e.event_type WHEN 'view' THEN 'email-exact' WHEN 'click' THEN 'name+org' WHEN 'signup' THEN 'email-username' WHEN 'error' THEN 'name+domain-broad' ELSE 'org-website' END AS label,
       CASE e.event_id % 7 WHEN 0 THEN concat('https://www.linkedin.com/in/', replace(pt.p_name, ' ', '-')) WHEN 1 THEN concat('https://acme.com/team/', replace(pt.p_name, ' ', '-'))
            WHEN 2 THEN 'https://rocketreach.co/people' WHEN 3 THEN concat('https://www.zoominfo.com/p/', cast(e.event_id AS string))
            WHEN 4 THEN concat('https://uk.linkedin.com/in/', replace(pt.p_name, ' ', '-'), '/') WHEN 5 THEN concat('https://x.com/', replace(pt.p_name, ' ', ''), '?ref=1')
            ELSE concat('https://faculty.uni.edu/people/', cast(e.event_id % 50 AS string), '/') END AS url,
       CASE WHEN e.event_id % 7 = 3 THEN concat(pt.p_name, ' Email & Phone Number | ', c.c_mktsegment, ' ZoomInfo') ELSE concat(pt.p_name, ' - profile') END AS title,
       CASE WHEN e.event_id % 5 = 0 THEN concat('See https://www.linkedin.com/in/', replace(pt.p_name, ' ', '-'), '-', cast(e.event_id % 3 AS string), '/ now') ELSE concat('About ', pt.p_name, ' ', e.props) END AS description
FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN part pt ON pt.p_partkey = c.c_custkey
"""

VIEWS["followed_pages"] = """
SELECT concat('https://faculty.uni.edu/people/', cast(page_id AS string), '/') AS url,
       concat(html, '<a href="https://www.linkedin.com/in/fac-', cast(page_id % 20 AS string), '/">x</a>') AS html
FROM pages
"""

VIEWS["team_pages"] = """
SELECT concat('https://', split_part(email, '@', 2), '/team/', cast(source_row AS string)) AS url,
       concat('<html><nav><a href="/home">Home</a></nav><p>', replace(name, ',', ' '), ' leads work on ', country, '.</p><a href="/people/', replace(split_part(name, ',', 1), ' ', '-'),
              '">Read more</a> <a class="n" href="https://www.linkedin.com/in/x', cast(source_row % 30 AS string), '?t=1"><b>', split_part(name, ' ', 1), '</b> ', coalesce(nullif(split_part(name, ' ', 2), ''), 'Q'),
              ' - bio</a><a href="mailto:', email, '">mail</a><a href="#top">', name, '</a></html>') AS html
FROM people WHERE email LIKE '%@%' AND name <> ''
"""

VIEWS["author_records"] = """
SELECT id AS profile_id, source_row AS pos, concat('{"id": "https://authors.example.org/A', cast(source_row AS string), '", "display_name": "', CASE WHEN source_row % 5 = 0 THEN 'Someone Else' ELSE split_part(name, ',', 1) END,
       '", "works_count": ', cast(source_row % 3 AS string), ', "last_known_institution": {"homepage_url": "https://www.', CASE WHEN source_row % 2 = 0 THEN 'uni.edu' ELSE 'other.net' END, '", "display_name": "Acme University"}}') AS body
FROM people WHERE name <> ''
"""

VIEWS["code_records"] = """
SELECT id AS profile_id, source_row AS pos, concat('{"login": "', replace(split_part(name, ',', 1), ' ', CASE WHEN source_row % 2 = 0 THEN '-' ELSE 'zz' END), '", "name": "', split_part(name, ',', 1), '", "company": "', CASE WHEN source_row % 3 = 0 THEN 'acme.com' ELSE '' END,
       '", "email": "', CASE WHEN source_row % 4 = 0 THEN email ELSE '' END, '", "bio": "', CASE WHEN source_row % 5 = 0 THEN concat('I am ', split_part(name, ',', 1)) ELSE '' END, '", "public_repos": ', cast(source_row % 2 AS string), '}') AS body
FROM people WHERE name <> ''
"""

VIEWS["publication_records"] = """
SELECT id AS profile_id, source_row AS pos, concat('{"', CASE source_row % 4 WHEN 0 THEN 'results' WHEN 1 THEN 'publications' WHEN 2 THEN 'hits' ELSE 'items' END, '": [{"', CASE WHEN source_row % 2 = 0 THEN 'base_url": "https://' ELSE 'custom_domain": "' END,
       replace(split_part(name, ',', 1), ' ', ''), '.example.com", "name": "Notes of ', CASE WHEN source_row % 3 = 0 THEN split_part(name, ',', 1) ELSE 'nobody' END, '", "description": "', CASE WHEN source_row % 5 = 0 THEN concat('By ', split_part(name, ',', 1)) ELSE '' END, '"}]}') AS body
FROM people WHERE name <> ''
"""

VIEWS["tries"] = """
SELECT profile_id, pos AS turn, url, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN '404_not_found' WHEN 'signup' THEN '5xx_persisted' WHEN 'error' THEN 'empty_body' ELSE CASE WHEN value > 60 THEN 'out_of_credits' ELSE 'non_200:503' END END AS outcome,
       value > 40 AS verified, CASE WHEN user_id % 4 = 0 THEN 'user' ELSE 'resolved' END AS linkedin_url_source
FROM (SELECT concat('p', cast(user_id AS string), '-', cast(event_id % 29 AS string)) AS profile_id, event_id AS pos, concat('https://www.linkedin.com/in/t', cast(event_id AS string)) AS url, event_type, value, user_id FROM events) e
"""

VIEWS["calls"] = """
SELECT o_orderkey AS call_id, concat('p', cast(o_custkey AS string)) AS profile_id,
       CASE o_orderkey % 11 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 402 WHEN 4 THEN 418 ELSE 200 END AS status,
       CASE o_orderkey % 11 WHEN 3 THEN 'not enough Credits' WHEN 5 THEN '' WHEN 6 THEN '{broken' WHEN 7 THEN '{"error": "gone"}'
            ELSE concat('{"full_name": "N', cast(o_custkey AS string), '", "city": "', o_orderpriority, '", "experiences": [{"company": "C', cast(o_orderkey % 7 AS string),
                        '", "title": "T', cast(o_orderkey % 5 AS string), '", "starts_at": {"year": 2010}, "ends_at": {"year": 2015}}, {"company": "Past", "title": null, "starts_at": null}]}') END AS body
FROM orders
"""

VIEWS["judge_responses"] = """
SELECT o_orderkey AS batch_id,
       CASE o_orderkey % 5 WHEN 0 THEN concat('```json', chr(10), '[{"id": "p', cast(o_custkey AS string), '", "s": ', cast(o_orderkey % 130 AS string), ', "r": "ok"}]', chr(10), '```')
            WHEN 1 THEN concat('[{"id": "p', cast(o_custkey AS string), '", "score": ', cast(o_orderkey % 90 AS string), '}, {"id": "x", "s": -4, "reasoning": "no"}]')
            WHEN 2 THEN concat('{"p', cast(o_custkey AS string), '": ', cast(o_orderkey % 101 AS string), '}')
            WHEN 3 THEN concat('{"p', cast(o_custkey AS string), '": {"s": 55, "r": "fit"}}') ELSE 'sorry, no answer' END AS text,
       concat('p', cast(o_custkey AS string)) AS profile_id
FROM orders
"""

VIEWS["arbiter_responses"] = """
SELECT concat('p', cast(c_custkey AS string)) AS profile_id,
       CASE c_custkey % 5 WHEN 0 THEN '{"winner_index": 0, "confidence": "HIGH", "reason": "slug"}' WHEN 1 THEN '{"winner_index": null, "confidence": "sure", "reason": ""}'
            WHEN 2 THEN concat('```json', chr(10), '{"winner_index": 1, "confidence": "medium", "reason": "title"}', chr(10), '```') WHEN 3 THEN 'I cannot tell' ELSE 'ok {"winner_index": 9, "confidence": "low", "reason": "org"} end' END AS text
FROM customer
"""

VIEWS["record_pages"] = """
SELECT o_custkey AS page_no,
       concat('{"records": [{"id": "rec', cast(min(o_orderkey) AS string), '", "fields": {"Name": "N', cast(o_custkey AS string), '", "Tags": ["a", "b', cast(count(*) AS string), '"], "Note": null}},',
              '{"id": "rec', cast(max(o_orderkey) AS string), 'b", "fields": {"Name": "M", "Total": ', cast(count(*) AS string), '}}], "offset": "x"}') AS body
FROM orders GROUP BY o_custkey
"""

_NAME = re.compile(r"\b([a-z_]+)\b")


def needed_views(sql: str) -> list[str]:
    """Views a statement reads, directly or through others, in definition order."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(_NAME.findall(todo.pop())) & VIEWS.keys():
            if name not in wanted:
                wanted.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def with_views(sql: str) -> str:
    """The statement with the definitions of the views it reads in front."""
    names = needed_views(sql)
    if not names:
        return sql
    defined = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {defined},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {defined},\n{body[5:]}"
    return f"WITH {defined}\n{body}"


class Source:
    """The given tables and the views over them, read lazily from one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, statement: str) -> DataFrame:
        full = with_views(statement)
        for name in set(_NAME.findall(full)) & set(TABLES):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(full)
