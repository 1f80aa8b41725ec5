"""Queries of the text, name, e-mail, URL and HTML functions."""

from pyspark.sql import functions as F

from rollcall.functions import emails, html, names, text, urls
from rollcall.plans.registry import query


@query("strip_control_chars", """
SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS cleaned,
       cast(length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS bigint) AS dropped
FROM documents""")
def strip_control_chars(src):
    body = F.col("text")
    clean = text.strip_controls(body)
    return src("documents").select(
        "doc_id", F.md5(clean).alias("cleaned"),
        (F.length(body) - F.length(clean)).cast("bigint").alias("dropped"))


@query("fold_accents", """
SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents""")
def fold_accents(src):
    return src("documents").select("doc_id", F.md5(text.fold(F.col("text"), "NFD")).alias("folded"))


_NAME_KEY = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '\b(dr|prof|mr|mrs|ms|sir|col|lt|gen|ret|jr|sr|iii?|iv)\b\.?', '', 'gi'), '[^a-zA-Z\s]', '', 'g')), '\s+', ' ', 'g'))"""
_ORG_KEY = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '\b(inc|llc|ltd|corp|co|company|the|of|for)\b\.?', '', 'gi'), '[^a-zA-Z\s]', '', 'g')), '\s+', ' ', 'g'))"""


@query("dedup_keys", f"""
SELECT row_id, {_NAME_KEY.format(c='raw_name')} AS name_key, {_ORG_KEY.format(c='raw_org')} AS org_key FROM raw_fields""")
def dedup_keys(src):
    return src("raw_fields").select(
        "row_id", names.name_key(F.col("raw_name")).alias("name_key"), names.org_key(F.col("raw_org")).alias("org_key"))


_AUDIT = r"""trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(regexp_replace({c}, '[®™©]', '', 'g'), '\([^)]*\)', ' ', 'g')),
  ',?\s*\b(ph\s*\.?\s*d\.?|m\s*\.?\s*d\.?|j\s*\.?\s*d\.?|d\s*\.?\s*phil\.?|esq\.?|cpa|cfa|cfp|clu|chfc|ricp|pmp|mba|mph|msw|mfa|ma|ms|bs|ba|jr\.?|sr\.?|ii|iii|iv|reg\.?|rn|np|lcsw|pe|aia|pharmd)\b\.?', ' ', 'gi')),
  '[^a-z0-9\- ]', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("audit_names", f"""
WITH t AS (SELECT row_id, {_AUDIT.format(c='raw_name')} AS form FROM raw_fields),
u AS (SELECT row_id, form, list_filter(string_split(form, ' '), lambda x: x <> '') AS toks FROM t)
SELECT row_id, form AS audit_form, cast(len(toks) AS int) AS n_tokens,
       coalesce(list_filter(toks, lambda x: x NOT IN ('jr','sr','ii','iii','iv','phd','ph','md','dr','esq'))[-1], toks[-1], '') AS last_token FROM u""")
def audit_names(src):
    tokens = names.audit_tokens(F.col("raw_name"))
    return src("raw_fields").select(
        "row_id", names.audit_form(F.col("raw_name")).alias("audit_form"), F.size(tokens).alias("n_tokens"),
        names.audit_last(tokens).alias("last_token"))


_TAIL = r"""',?\s*\b(ph\.?\s*d\.?|m\.?\s*d\.?|j\.?\s*d\.?|d\.?\s*phil\.?|esq\.?|mba|mph|ma|ms|ba|bs|jr\.?|sr\.?|iii|iv|ii)\b\.?\s*$'"""


def _tails(c: str) -> str:
    for _ in range(4):
        c = f"trim(trim(trim(regexp_replace({c}, {_TAIL}, '', 'i')), ','))"
    return c


SIGNAL_TOKENS = (
    r"list_filter(string_split_regex(regexp_replace(" + _tails(
        r"trim(regexp_replace(lower(strip_accents({c})), '\([^)]*\)', ' ', 'g'))")
    + r", '[^a-z\- ]', ' ', 'g'), ' +'), lambda x: x <> '')"
)


@query("name_signals", f"""
WITH t AS (SELECT row_id, {SIGNAL_TOKENS.format(c='raw_name')} AS toks FROM raw_fields),
u AS (SELECT row_id, toks[1:coalesce(list_max(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN toks[i] IN
  ('jr','sr','ii','iii','iv','phd','md','esq','mba','mph','dphil','ma','ms','bs','ba','jd','ph','d','m') THEN 0 ELSE i END)), 0)] AS toks FROM t),
v AS (SELECT row_id, coalesce(toks[1], '') AS f, CASE WHEN len(toks) > 1 THEN toks[-1] ELSE '' END AS l FROM u),
w AS (SELECT row_id, f, l, [f||'-'||l, f||l, f||'.'||l, f||'_'||l, l||'-'||f, l||f,
   CASE WHEN length(l) >= 3 THEN f[1]||l END, CASE WHEN length(l) >= 3 AND length(f[1]||'-'||l) >= 5 THEN f[1]||'-'||l END, f||l[1], f||'-'||l[1]] AS s FROM v)
SELECT row_id, f AS first_name, l AS last_name,
  CASE WHEN f <> '' AND l <> '' THEN (SELECT string_agg(x, '|' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT trim(unnest(s), '-_.') AS x, unnest(range(1, 11)) AS i) WHERE length(x) >= CASE WHEN i = 7 THEN 4 ELSE 5 END GROUP BY x))
       WHEN length(f) >= 5 THEN f ELSE '' END AS slugs
FROM w""")
def name_signals(src):
    tokens = names.signal_tokens(F.col("raw_name"))
    parts = src("raw_fields").select(
        "row_id", names.signal_first(tokens).alias("first_name"), names.signal_last(tokens).alias("last_name"))
    slugs = names.name_slugs(F.col("first_name"), F.col("last_name"))
    return parts.select("row_id", "first_name", "last_name", F.array_join(slugs, "|").alias("slugs"))


PERSONAL = "('gmail.com','hotmail.com','yahoo.com','outlook.com','me.com','icloud.com','aol.com','protonmail.com','proton.me','msn.com','live.com','mail.com','ymail.com','zoho.com','hey.com','pm.me')"
DOMAIN_SQL = "CASE WHEN contains({e}, '@') THEN regexp_replace(lower(trim({e})), '^[^@]*@', '') ELSE '' END"


@query("email_cohorts", f"""
WITH t AS (SELECT id, email, organization, {DOMAIN_SQL.format(e='email')} AS dom FROM people)
SELECT id, dom AS domain,
  CASE WHEN dom = '' THEN 'no_email' WHEN dom IN {PERSONAL} THEN 'personal' WHEN dom LIKE '%.edu' OR dom LIKE '%.ac.uk' OR dom LIKE '%.edu.au' THEN 'edu'
       WHEN dom LIKE '%.gov' OR dom LIKE '%.gov.uk' THEN 'gov' WHEN dom LIKE '%.org' THEN 'org' ELSE 'corp' END AS signal_cohort,
  CASE WHEN email = '' THEN 'no_email' WHEN dom = '' THEN 'malformed' WHEN dom IN {PERSONAL} THEN 'personal' WHEN dom LIKE '%.edu' THEN 'edu'
       WHEN dom LIKE '%.gov' THEN 'gov' WHEN dom LIKE '%.org' THEN 'org' ELSE 'corp' END AS report_type,
  concat(CASE WHEN email = '' THEN 'no_email' WHEN dom IN {PERSONAL} THEN 'personal' WHEN dom LIKE '%.edu' THEN 'edu' WHEN dom LIKE '%.gov' THEN 'gov' ELSE 'corp' END,
         CASE WHEN trim(organization) = '' THEN '+noorg' ELSE '+org' END) AS sampler_cohort,
  CASE WHEN dom IN {PERSONAL} THEN '' ELSE dom END AS org_domain,
  CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 1)) ELSE '' END AS email_local,
  regexp_extract(dom, '([^.]+\\.[^.]+|[^.]+)$', 1) AS base_domain,
  coalesce(nullif(trim(regexp_replace(split_part(dom, '.', 1), '(mail|email|info|contact|admin|support)', '', 'g')), ''), split_part(dom, '.', 1)) AS company_stem
FROM t""")
def email_cohorts(src):
    email = F.col("email")
    return src("people").select(
        "id", emails.signal_domain(email).alias("domain"), emails.signal_cohort(email).alias("signal_cohort"),
        emails.report_email_type(email).alias("report_type"),
        emails.sampler_cohort(email, F.col("organization")).alias("sampler_cohort"),
        emails.org_domain(email).alias("org_domain"), emails.email_local(email).alias("email_local"),
        emails.base_domain(email).alias("base_domain"),
        emails.company_stem(emails.signal_domain(email)).alias("company_stem"))


@query("name_and_org_buckets", """
SELECT id, CASE WHEN trim(name) = '' THEN 'no_name' ELSE CASE len(string_split_regex(trim(name), '\\s+')) WHEN 1 THEN 'single_token' WHEN 2 THEN 'two_token' ELSE 'three_plus_token' END END AS name_bucket,
  CASE WHEN trim(organization) = '' THEN 'no_org' ELSE 'org_present' END AS org_flag,
  coalesce(nullif(upper(list_aggregate(list_transform(list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '')[1:2], lambda x: x[1]), 'string_agg', '')), ''), '?') AS initials
FROM people""")
def name_and_org_buckets(src):
    return src("people").select(
        "id", names.name_bucket(F.col("name")).alias("name_bucket"), names.org_flag(F.col("organization")).alias("org_flag"),
        names.initials(F.col("name")).alias("initials"))


@query("link_forms", r"""
SELECT row_id,
  CASE WHEN v LIKE '@%' AND NOT contains(v, ' ') THEN concat('https://twitter.com/', substr(v, 2)) WHEN lower(v) LIKE 'www.%' AND regexp_matches(lower(v), 'twitter\.com|x\.com') THEN concat('https://', v)
       WHEN upper(v) IN ('NA','N/A','NONE') THEN '' ELSE v END AS twitter_link,
  CASE WHEN lower(v) LIKE 'www.linkedin.com%' THEN concat('https://', v) WHEN lower(v) LIKE 'linkedin.com%' THEN concat('https://www.', v)
       WHEN upper(v) IN ('NA','N/A','NONE') THEN '' ELSE v END AS linkedin_link
FROM (SELECT row_id, trim(raw_link) AS v FROM raw_fields)""")
def link_forms(src):
    return src("raw_fields").select(
        "row_id", urls.twitter_link(F.col("raw_link")).alias("twitter_link"),
        urls.linkedin_link(F.col("raw_link")).alias("linkedin_link"))


_BOUNDARY = r"regexp_replace({c}, '([^\s,;|])(https?://|www\.|linkedin\.com/|twitter\.com/|x\.com/|github\.com/|substack\.com/|medium\.com/)', '\1' || chr(10) || '\2', 'gi')"


@query("merged_links", f"""
WITH t AS (SELECT row_id, string_split_regex({_BOUNDARY.format(c=_BOUNDARY.format(c=_BOUNDARY.format(c='trim(raw_link)')))}, '[\\s,;|]+') AS p FROM raw_fields),
u AS (SELECT row_id, list_filter(list_transform(list_transform(p, lambda x: rtrim(rtrim(x, '/'), ',.')),
  lambda x: CASE WHEN regexp_matches(x, '(?i)^https?://') THEN x WHEN regexp_matches(x, '(?i)^(www\\.|(linkedin|twitter|x|github|substack|medium)\\.com/)') THEN concat('https://', x) END), lambda x: x IS NOT NULL) AS urls FROM t)
SELECT row_id, coalesce(array_to_string(urls, ' '), '') AS all_urls,
  coalesce(list_filter(urls, lambda x: contains(lower(x), 'linkedin.com/'))[1], '') AS linkedin_url,
  coalesce(list_filter(urls, lambda x: regexp_matches(lower(x), 'twitter\\.com/|x\\.com/'))[1], '') AS twitter_url,
  coalesce(list_filter(urls, lambda x: NOT regexp_matches(lower(x), 'linkedin\\.com/|twitter\\.com/|x\\.com/'))[1], '') AS other_url
FROM u""")
def merged_links(src):
    split = src("raw_fields").select("row_id", urls.split_merged_urls(F.col("raw_link")).alias("found"))
    found = F.col("found")
    return split.select(
        "row_id", F.array_join(found, " ").alias("all_urls"), urls.pick_merged(found, "linkedin").alias("linkedin_url"),
        urls.pick_merged(found, "twitter").alias("twitter_url"), urls.pick_merged(found, "other").alias("other_url"))


@query("url_canonical_forms", r"""
SELECT row_id, regexp_matches(url, '/in/|/company/') AND NOT regexp_matches(url, '/public-profile/settings|/feed/|/pub/dir/') AS valid_profile,
  regexp_matches(url, '^https?://(\w+\.)?linkedin\.com/in/') AS personal_profile,
  regexp_replace(regexp_replace(rtrim(trim(url), '/'), '[?#].*$', ''), '^http://', 'https://') AS vendor_form,
  regexp_replace(rtrim(lower(trim(url)), '/'), '[?#].*$', '') AS dedup_form,
  rtrim(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/') AS evidence_form,
  CASE WHEN contains(lower(url), 'linkedin.com') THEN split_part(rtrim(lower(trim(url)), '/'), '?', 1) ELSE rtrim(lower(trim(url)), '/') END AS truth_form
FROM raw_fields""")
def url_canonical_forms(src):
    url = F.col("url")
    return src("raw_fields").select(
        "row_id", urls.is_valid_profile_url(url).alias("valid_profile"), urls.is_personal_profile_url(url).alias("personal_profile"),
        urls.clean_profile_url(url).alias("vendor_form"), urls.dedup_url_key(url).alias("dedup_form"),
        urls.evidence_url_key(url).alias("evidence_form"), urls.truth_url_key(url).alias("truth_form"))


@query("url_parts", r"""
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
  lower(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)) AS last_segment FROM pages""")
def url_parts(src):
    url = F.col("url")
    return src("pages").select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"),
                               urls.last_segment(url).alias("last_segment"))


@query("url_handles", r"""
SELECT row_id, CASE WHEN lower(h) IN ('search','explore','home','settings','i','intent') THEN '' ELSE h END AS handle, code_user, slug,
  coalesce(nullif(regexp_extract(url, '[?&]id=([a-zA-Z0-9_-]+)', 1), ''), regexp_extract(url, 'docs\.google\.com/document/d/([a-zA-Z0-9_-]+)', 1)) AS file_id,
  CASE WHEN contains(lower(url), 'github.com') THEN 'github' WHEN regexp_matches(lower(url), 'twitter\.com|x\.com') THEN 'twitter'
       WHEN regexp_matches(lower(url), 'drive\.google\.com|docs\.google\.com') THEN 'gdrive' ELSE 'website' END AS link_type
FROM (SELECT row_id, url, regexp_extract(url, '(?:x\.com|twitter\.com)/([a-zA-Z0-9_]+)', 1) AS h, regexp_extract(raw_link, 'github\.com/([a-zA-Z0-9_-]+)', 1) AS code_user,
      regexp_extract(lower(url), '/in/([^/?#]+)', 1) AS slug FROM raw_fields)""")
def url_handles(src):
    url = F.col("url")
    return src("raw_fields").select(
        "row_id", urls.social_handle(url).alias("handle"), urls.code_user(F.col("raw_link")).alias("code_user"),
        urls.profile_slug(url).alias("slug"), urls.drive_file_id(url).alias("file_id"), urls.link_type(url).alias("link_type"))


BROKERS = r"spokeo\.com|beenverified\.com|whitepages\.com|radaris\.com|truepeoplesearch\.com|peekyou\.com|rocketreach\.com|clearbit\.com|zoominfo\.com|apollo\.io|contactout\.com|signalhire\.com|lusha\.com|hunter\.io|snov\.io|skrapp\.io|uplead\.com|leadiq\.com|seamless\.ai|nymeria\.io"


@query("followable_pages", f"""
SELECT w.pos, NOT regexp_matches(lower(w.url), '{BROKERS}') AND (
    (p.dom <> '' AND p.dom NOT IN {PERSONAL} AND contains(lower(w.url), p.dom)) OR regexp_matches(lower(w.url), '\\.edu|\\.gov|\\.ac\\.uk|\\.org/|\\.org$')) AS followable
FROM web_results w JOIN (SELECT id, {DOMAIN_SQL.format(e='email')} AS dom FROM people) p ON p.id = w.profile_id""")
def followable_pages(src):
    domains = src("people").select(F.col("id").alias("profile_id"), emails.signal_domain(F.col("email")).alias("dom"))
    return src("web_results").join(domains, "profile_id").select(
        "pos", urls.is_followable(F.col("url"), F.col("dom")).alias("followable"))


@query("harvested_links", r"""
WITH f AS (SELECT page_id, list_prepend(url, regexp_extract_all(html, '((?:https?://|www\.)[^\s,;|<>"''\\]+)', 1, 'i')) AS raw FROM pages),
g AS (SELECT page_id, list_filter(list_transform(raw, lambda x: regexp_replace(trim(x), '[.,;:)\]}>"]+$', '')), lambda x: x <> '') AS raw FROM f),
h AS (SELECT page_id, unnest(raw) AS x, unnest(range(1, len(raw) + 1)) AS i FROM g),
k AS (SELECT page_id, CASE WHEN lower(x) LIKE 'http%' THEN x ELSE concat('https://', x) END AS x, i FROM h),
d AS (SELECT page_id, arg_min(x, i) AS x, min(i) AS i FROM k GROUP BY page_id, lower(x)),
r AS (SELECT page_id, x, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM d WHERE lower(split_part(regexp_replace(x, '^https?://(www\.)?', '', 'i'), '/', 1)) NOT IN
 ('google.com','docs.google.com','drive.google.com','youtube.com','youtu.be','facebook.com','instagram.com','wikipedia.org'))
SELECT page_id, string_agg(x, ' ' ORDER BY rn) AS links FROM r WHERE rn <= 8 GROUP BY page_id""")
def harvested_links(src):
    return src("pages").select("page_id", F.array_join(urls.harvest_urls(F.col("html"), F.col("url")), " ").alias("links"))


_HIDDEN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '{r}', 'gis'), '<style[^>]*>.*?</style>', '{r}', 'gis'), '<nav[^>]*>.*?</nav>', '{r}', 'gis'), '<header[^>]*>.*?</header>', '{r}', 'gis'), '<footer[^>]*>.*?</footer>', '{r}', 'gis')"
_ARTICLE = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(" + _HIDDEN.format(r="") + ", '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '\"'), '\\s+', ' ', 'g'))"
PAGE_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(" + _HIDDEN.format(r=" ") + ", '<[^>]+>', ' ', 'g'), '&nbsp;|&amp;|&#\\d+;', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("html_text", f"""
SELECT page_id, md5({PAGE_TEXT}) AS text_md5, cast(length({PAGE_TEXT}) AS bigint) AS n_chars FROM pages""")
def html_text(src):
    body = html.page_text(F.col("html"))
    return src("pages").select("page_id", F.md5(body).alias("text_md5"), F.length(body).cast("bigint").alias("n_chars"))


@query("page_bios", f"""
WITH t AS (SELECT page_id, {_ARTICLE} AS body FROM pages),
u AS (SELECT page_id, body, list_filter(list_transform(string_split(body, '. '), lambda x: trim(x)), lambda x: length(x) > 20 AND length(x) < 500 AND NOT regexp_matches(x, '^(Cookie|Privacy|Terms|Copyright|©)')) AS s FROM t),
v AS (SELECT page_id, substr(CASE WHEN len(s) > 0 THEN concat(array_to_string(s[1:10], '. '), '.') ELSE body END, 1, 2000) AS bio FROM u)
SELECT page_id, md5(bio) AS bio_md5, length(bio) >= 50 AS usable FROM v""")
def page_bios(src):
    bios = src("pages").select("page_id", html.bio_text(html.article_text(F.col("html"))).alias("bio"))
    return bios.select("page_id", F.md5("bio").alias("bio_md5"), (F.length("bio") >= 50).alias("usable"))


@query("page_anchors", r"""
SELECT page_id, cast(count(*) AS bigint) AS n_links, md5(string_agg(href || '|' || txt, chr(10) ORDER BY i)) AS links_md5
FROM (SELECT page_id, i, trim(regexp_extract(a, '(?:^|\s)href\s*=\s*["'']?([^"''\s>]*)', 1, 'is')) AS href, trim(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS txt
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s([^>]*)>(.*?)</a\s*>', 1, 'is')) AS a, unnest(regexp_extract_all(html, '<a\s([^>]*)>(.*?)</a\s*>', 2, 'is')) AS t,
        unnest(range(1, len(regexp_extract_all(html, '<a\s([^>]*)>(.*?)</a\s*>', 1, 'is')) + 1)) AS i FROM pages)) GROUP BY page_id""")
def page_anchors(src):
    links = F.transform(html.anchors(F.col("html")), lambda a: F.concat(a["href"], F.lit("|"), a["text"]))
    return src("pages").select("page_id", links.alias("links")).where(F.size("links") > 0).select(
        "page_id", F.size("links").cast("bigint").alias("n_links"), F.md5(F.array_join("links", "\n")).alias("links_md5"))


@query("context_windows", f"""
WITH t AS (SELECT page_id, {PAGE_TEXT} AS body, lower(regexp_extract(html, '<title>(\\w+)', 1)) AS needle FROM pages),
u AS (SELECT *, position(needle IN lower(body)) AS hit FROM t)
SELECT page_id, CASE WHEN needle = '' OR hit = 0 THEN '' ELSE trim(substr(body, greatest(1, hit - 200), hit + 200 - greatest(1, hit - 200))) END AS snippet FROM u""")
def context_windows(src):
    needle = F.lower(F.regexp_extract("html", r"<title>([A-Za-z0-9_]+)", 1))
    return src("pages").select("page_id", html.window_around(html.page_text(F.col("html")), needle).alias("snippet"))


@query("avatar_keys", """
SELECT id, md5(lower(trim(email))) AS avatar_key FROM people WHERE email <> ''""")
def avatar_keys(src):
    return src("people").where("email <> ''").select("id", text.avatar_key(F.col("email")).alias("avatar_key"))
