"""URL expressions: canonical forms, tests, splitting, harvesting, anchors in HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import (
    BLANK_WORDS,
    BROKER_HOSTS,
    HARVEST_SKIP_HOSTS,
    MERGED_FIELD_HOSTS,
    PERSONAL_DOMAINS,
    RESERVED_HANDLES,
)
from rollcall.functions.text import has_any, let, text, trim_all

PROFILE_URL = r"https?://(?:\w+\.)?linkedin\.com/in/[\w-]+/?"


def _no_tail(col: Column) -> Column:
    return F.regexp_replace(col, r"[?#].*$", "")


def _no_slash(col: Column) -> Column:
    return F.regexp_replace(col, "/+$", "")


# Four canonical forms exist side by side; each belongs to one family of operators.
def clean_profile_url(url: Column) -> Column:
    """Vendor form: slash, then query and fragment stripped, https, case kept."""
    return F.regexp_replace(_no_tail(_no_slash(trim_all(url))), "^http://", "https://")


def dedup_url_key(url: Column) -> Column:
    """Duplicate key: lower case, slash stripped before the query only."""
    return _no_tail(_no_slash(F.lower(trim_all(url))))


def evidence_url_key(url: Column) -> Column:
    """Evidence key: lower case, query and fragment stripped before the slash."""
    return _no_slash(_no_tail(F.lower(trim_all(url))))


def truth_url_key(url: Column) -> Column:
    """Ground-truth key: the query goes only for profile URLs."""
    bare = _no_slash(F.lower(trim_all(url)))
    return F.when(F.contains(bare, F.lit("linkedin.com")), F.split_part(bare, F.lit("?"), F.lit(1))).otherwise(bare)


def loose_url_key(url: Column) -> Column:
    return _no_slash(F.lower(text(url)))


def is_valid_profile_url(url: Column) -> Column:
    value = text(url)
    return value.rlike("/in/|/company/") & ~value.rlike("/public-profile/settings|/feed/|/pub/dir/")


def is_personal_profile_url(url: Column) -> Column:
    return text(url).rlike(r"^https?://(\w+\.)?linkedin\.com/in/")


def profile_urls_in(body: Column) -> Column:
    """Distinct profile URLs of a text, first seen first, without the closing slash."""
    found = F.regexp_extract_all(text(body), F.lit(f"({PROFILE_URL})"), F.lit(1))
    return F.array_distinct(F.transform(found, _no_slash))


def first_profile_url_in(body: Column) -> Column:
    return _no_slash(F.regexp_extract(text(body), PROFILE_URL, 0))


def _is_blank_word(value: Column) -> Column:
    return F.upper(value).isin(BLANK_WORDS)


def twitter_link(raw: Column) -> Column:
    value = trim_all(raw)
    bare = F.startswith(F.lower(value), F.lit("www.")) & F.lower(value).rlike(r"twitter\.com|x\.com")
    return (
        F.when(F.startswith(value, F.lit("@")) & ~F.contains(value, F.lit(" ")),
               F.concat(F.lit("https://twitter.com/"), F.substring(value, 2, 1 << 30)))
        .when(bare, F.concat(F.lit("https://"), value))
        .when(_is_blank_word(value), "")
        .otherwise(value)
    )


def linkedin_link(raw: Column) -> Column:
    value = trim_all(raw)
    lowered = F.lower(value)
    return (
        F.when(F.startswith(lowered, F.lit("www.linkedin.com")), F.concat(F.lit("https://"), value))
        .when(F.startswith(lowered, F.lit("linkedin.com")), F.concat(F.lit("https://www."), value))
        .when(_is_blank_word(value), "")
        .otherwise(value)
    )


def split_merged_urls(raw: Column) -> Column:
    """URLs of a field in which several were run together, schemes completed."""
    hosts = "|".join(rf"{h}\.com/" for h in MERGED_FIELD_HOSTS)
    apart = F.regexp_replace(
        trim_all(raw), rf"(?i)(?<!^)(?<![\s,;|])(https?://|www\.|{hosts})", "\n$1"
    )
    parts = F.transform(
        F.split(apart, r"[\s,;|]+"), lambda p: F.regexp_replace(_no_slash(p), "[,.]+$", "")
    )
    known = rf"(?i)^(www\.|({'|'.join(MERGED_FIELD_HOSTS)})\.com/)"
    with_scheme = F.transform(
        parts,
        lambda p: F.when(p.rlike("(?i)^https?://"), p).when(p.rlike(known), F.concat(F.lit("https://"), p)),
    )
    return F.array_compact(with_scheme)


def pick_merged(urls: Column, want: str) -> Column:
    """First linkedin, twitter or other URL of a split field."""
    tests = {
        "linkedin": lambda u: F.contains(F.lower(u), F.lit("linkedin.com/")),
        "twitter": lambda u: F.lower(u).rlike(r"twitter\.com/|://x\.com/|://[^:]*x\.com/"),
        "other": lambda u: ~F.lower(u).rlike(r"linkedin\.com/|twitter\.com/|x\.com/"),
    }
    return F.coalesce(F.get(F.filter(urls, tests[want]), 0), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(url), r"(?i)^https?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(text(url), r"(?i)^https?://[^/?#]*([^?#]*)", 1)


def last_segment(url: Column) -> Column:
    return F.lower(F.regexp_extract(_no_slash(text(url)), "([^/]*)$", 1))


def profile_slug(url: Column) -> Column:
    return F.regexp_extract(F.lower(text(url)), r"/in/([^/?#]+)", 1)


def code_user(url: Column) -> Column:
    return F.regexp_extract(text(url), r"github\.com/([a-zA-Z0-9_-]+)", 1)


def social_handle(url: Column) -> Column:
    handle = F.regexp_extract(text(url), r"(?:x\.com|twitter\.com)/([a-zA-Z0-9_]+)", 1)
    return F.when(F.lower(handle).isin(RESERVED_HANDLES), "").otherwise(handle)


def drive_file_id(url: Column) -> Column:
    value = text(url)
    shapes = [
        r"drive\.google\.com/file/d/([a-zA-Z0-9_-]+)",
        r"[?&]id=([a-zA-Z0-9_-]+)",
        r"docs\.google\.com/document/d/([a-zA-Z0-9_-]+)",
        r"docs\.google\.com/spreadsheets/d/([a-zA-Z0-9_-]+)",
    ]
    found = [F.nullif(F.regexp_extract(value, s, 1), F.lit("")) for s in shapes]
    return F.coalesce(*found, F.lit(""))


def link_type(url: Column) -> Column:
    value = F.lower(text(url))
    return (
        F.when(F.contains(value, F.lit("github.com")), "github")
        .when(value.rlike(r"twitter\.com|x\.com"), "twitter")
        .when(value.rlike(r"drive\.google\.com|docs\.google\.com"), "gdrive")
        .otherwise("website")
    )


def is_followable(url: Column, email_domain: Column) -> Column:
    """May this page be read for profile links: own domain, academic, public or .org hosts."""
    value, domain = F.lower(text(url)), text(email_domain)
    own = (domain != "") & ~domain.isin(PERSONAL_DOMAINS) & F.contains(value, domain)
    public = value.rlike(r"\.edu|\.gov|\.ac\.uk|\.org/|\.org$")
    return (value != "") & ~has_any(value, BROKER_HOSTS) & (own | public)


def harvest_urls(body: Column, primary: Column, keep: int = 8) -> Column:
    """Distinct links of a text after the primary one, noise hosts left out."""
    found = F.regexp_extract_all(text(body), F.lit(r"(?i)((?:https?://|www\.)[^\s,;|<>\"'\\]+)"), F.lit(1))
    raw = F.concat(F.array(text(primary)), found)
    bare = F.transform(raw, lambda u: F.regexp_replace(trim_all(u), r'[.,;:)\]}>"]+$', ""))
    full = F.transform(
        F.filter(bare, lambda u: u != ""),
        lambda u: F.when(F.startswith(F.lower(u), F.lit("http")), u).otherwise(
            F.concat(F.lit("https://"), F.regexp_replace(u, "^/+", ""))
        ),
    )
    def once(links: Column) -> Column:
        return let(F.transform(links, F.lower), lambda low: F.array_compact(F.transform(
            links, lambda u, i: F.when(F.array_position(low, F.lower(u)) == i + 1, u))))

    first_seen = let(full, once)
    bare_host = lambda u: F.lower(F.split_part(F.regexp_replace(u, r"(?i)^https?://(www\.)?", ""), F.lit("/"), F.lit(1)))
    kept = F.filter(first_seen, lambda u: ~bare_host(u).isin(HARVEST_SKIP_HOSTS))
    return F.slice(kept, 1, keep)


def match_slug(slugs: Column, url: Column) -> Column:
    """First slug found inside the URL, else empty."""
    value = F.lower(text(url))
    return F.coalesce(F.get(F.filter(slugs, lambda s: F.contains(value, s)), 0), F.lit(""))
