"""HTML expressions: visible text, bio sentences, anchors, context windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import BOILERPLATE_STARTS
from rollcall.functions.text import SPACE, squeeze, text

_HIDDEN = r"(?is)<(script|style|nav|header|footer)[^>]*>.*?</\1>"


def page_text(html: Column) -> Column:
    """Compact text of a page; entities become spaces."""
    shown = F.regexp_replace(F.regexp_replace(text(html), _HIDDEN, " "), "<[^>]+>", " ")
    return squeeze(F.regexp_replace(shown, r"&nbsp;|&amp;|&#\d+;", " "))


def article_text(html: Column) -> Column:
    """Text of a page with the common entities decoded."""
    shown = F.regexp_replace(F.regexp_replace(text(html), _HIDDEN, ""), "<[^>]+>", " ")
    for entity, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')]:
        shown = F.replace(shown, F.lit(entity), F.lit(char))
    return squeeze(shown)


def bio_text(body: Column, most: int = 10, longest: int = 2000) -> Column:
    """Sentences that read like a bio, else the start of the text."""
    starts = "^(" + "|".join(BOILERPLATE_STARTS) + ")"
    sentences = F.filter(
        F.transform(F.split(body, r"\. "), lambda s: F.trim(s)),
        lambda s: (F.length(s) > 20) & (F.length(s) < 500) & ~s.rlike(starts),
    )
    joined = F.concat(F.array_join(F.slice(sentences, 1, most), ". "), F.lit("."))
    return F.left(F.when(F.size(sentences) > 0, joined).otherwise(body), F.lit(longest))


def anchors(html: Column) -> Column:
    """Array of (href, text) for every link that has both an opening and a closing tag."""
    pattern = r"(?is)<a\s([^>]*)>(.*?)</a\s*>"
    attrs = F.regexp_extract_all(text(html), F.lit(pattern), F.lit(1))
    inner = F.regexp_extract_all(text(html), F.lit(pattern), F.lit(2))
    href = lambda a: F.trim(F.regexp_extract(a, r"""(?is)(?:^|\s)href\s*=\s*["']?([^"'\s>]*)""", 1))
    label = lambda t: squeeze(F.regexp_replace(t, "<[^>]+>", ""))
    return F.transform(
        F.arrays_zip(attrs.alias("attrs"), inner.alias("inner")),
        lambda x: F.struct(href(x["attrs"]).alias("href"), label(x["inner"]).alias("text")),
    )


def resolve_href(page_url: Column, href: Column) -> Column:
    """Absolute form of a link found on a page."""
    origin = F.regexp_extract(page_url, r"(?i)^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(page_url, "[?#].*$", ""), r"(?i)^(https?://[^/]*(?:/.*)?/)[^/]*$", 1)
    return (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(page_url, "^([^:]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(href.rlike("^[?#]"), F.concat(F.regexp_replace(page_url, "[?#].*$", ""), href))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )


def window_around(body: Column, needle: Column, width: int = 400) -> Column:
    """Text within ``width`` characters centred on the first hit, else empty."""
    half = width // 2
    at = F.position(F.lower(needle), F.lower(body))
    start = F.greatest(F.lit(1), at - half)
    cut = F.substr(body, start, at + half - start)
    return F.when((text(needle) == "") | (at == 0), "").otherwise(
        F.trim(F.regexp_replace(cut, f"{SPACE}+", " "))
    )
