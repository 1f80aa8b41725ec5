"""Person and organisation names: keys, splits, slugs, token comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import (
    AUDIT_CREDENTIAL_PATTERN,
    COMMON_FIRST_NAMES,
    CREDENTIAL_TAIL_PATTERN,
    CREDENTIAL_TOKENS,
    NAME_TITLE_PATTERN,
    ORG_NOISE_PATTERN,
    SUFFIX_TOKENS,
)
from rollcall.functions.text import fold, split_words, squeeze, strip_accents, text, trim_all


def _letters_key(col: Column, noise: str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text(col), noise, ""), r"[^a-zA-Z\s]", "")
    return F.lower(squeeze(bare))


def name_key(name: Column) -> Column:
    return _letters_key(name, NAME_TITLE_PATTERN)


def org_key(org: Column) -> Column:
    return _letters_key(org, ORG_NOISE_PATTERN)


def loose_key(col: Column) -> Column:
    """Case-, accent- and whitespace-insensitive form for comparing fields."""
    return F.lower(squeeze(strip_accents(col)))


def name_bucket(name: Column) -> Column:
    n = F.size(split_words(name))
    return (
        F.when(n == 0, "no_name").when(n == 1, "single_token").when(n == 2, "two_token")
        .otherwise("three_plus_token")
    )


def org_flag(org: Column) -> Column:
    return F.when(trim_all(org) == "", "no_org").otherwise("org_present")


def looks_like_person(value: Column) -> Column:
    words = split_words(value)
    first = F.regexp_replace(F.lower(F.get(words, 0)), r"\.+$", "")
    shaped = F.length(value).between(2, 80) & F.regexp_replace(value, r"[.\-',()]", "").rlike(r"^[\p{L}\s]*$")
    named = first.isin(COMMON_FIRST_NAMES) | F.exists(words, lambda w: w.rlike(r"^\p{Lu}"))
    return F.coalesce(shaped & F.size(words).between(1, 6) & named, F.lit(False))


def audit_form(name: Column) -> Column:
    """Form compared by the wrong-person audit."""
    bare = F.regexp_replace(F.regexp_replace(text(name), "[®™©]", ""), r"\([^)]*\)", " ")
    plain = F.regexp_replace(strip_accents(bare), AUDIT_CREDENTIAL_PATTERN, " ")
    return squeeze(F.regexp_replace(F.lower(plain), r"[^a-z0-9\- ]", " "))


def audit_tokens(name: Column) -> Column:
    return F.filter(F.split(audit_form(name), " "), lambda t: t != "")


def audit_last(tokens: Column) -> Column:
    """Last token that is no suffix; the very last when all are."""
    real = F.filter(tokens, lambda t: ~t.isin(SUFFIX_TOKENS))
    return F.coalesce(F.get(real, F.size(real) - 1), F.get(tokens, F.size(tokens) - 1), F.lit(""))


def signal_tokens(name: Column) -> Column:
    """Name tokens without parentheses, credential tails and credential-shaped last tokens."""
    value = F.regexp_replace(F.lower(trim_all(strip_accents(name))), r"\([^)]*\)", " ")
    for _ in range(4):
        value = F.trim(F.trim(trim_all(F.regexp_replace(value, CREDENTIAL_TAIL_PATTERN, "")), F.lit(",")))
    tokens = F.filter(F.split(F.regexp_replace(value, r"[^a-z\- ]", " "), " +"), lambda t: t != "")
    # Position of the last token that is not credential-shaped.
    real = F.transform(tokens, lambda t, i: F.when(~t.isin(CREDENTIAL_TOKENS), i + 1).otherwise(0))
    return F.slice(tokens, F.lit(1), F.coalesce(F.array_max(real), F.lit(0)))


def signal_first(tokens: Column) -> Column:
    return F.coalesce(F.get(tokens, 0), F.lit(""))


def signal_last(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.get(tokens, F.size(tokens) - 1)).otherwise("")


def name_slugs(first: Column, last: Column) -> Column:
    """Ordered URL forms of a name, the telling ones first."""
    initial, final = F.left(first, F.lit(1)), F.left(last, F.lit(1))
    dash, none = F.lit("-"), F.lit("")

    def form(*parts: Column, shortest: int = 5, when: Column | None = None) -> Column:
        slug = F.trim(F.concat(*parts), F.lit("-_."))
        fits = F.length(slug) >= shortest
        return F.when(fits if when is None else fits & when, slug)

    long_last = F.length(last) >= 3
    pairs = F.array(
        form(first, dash, last), form(first, last), form(first, F.lit("."), last), form(first, F.lit("_"), last),
        form(last, dash, first), form(last, first),
        form(initial, last, shortest=4, when=long_last), form(initial, dash, last, when=long_last),
        form(first, final), form(first, dash, final),
    )
    return (
        F.when((first != none) & (last != none), F.array_distinct(F.array_compact(pairs)))
        .when(F.length(first) >= 5, F.array(first))
        .otherwise(F.array().cast("array<string>"))
    )


def canonical_first_name(name: Column) -> Column:
    return F.regexp_replace(fold(name), r"[^\p{L}\-]", "")


def _is_initial(token: Column) -> Column:
    return token.rlike(r"^\p{L}$")


def tokens_match(a: Column, b: Column) -> Column:
    """Equal tokens, or an initial standing for the other one."""
    return (a == b) | (_is_initial(a) & F.startswith(b, a)) | (_is_initial(b) & F.startswith(a, b))


def token_overlap(a: Column, b: Column, first_names_equal: Column) -> Column:
    """Greedy ordered overlap: matched over union, each token of ``b`` used once.

    ``first_names_equal`` says whether the two first tokens are known aliases; an alias
    counts only between those two positions.
    """
    def step(used: Column, token: Column, position: Column) -> Column:
        free = F.transform(
            b,
            lambda other, j: F.when(
                ~F.array_contains(used, j)
                & (tokens_match(token, other) | ((position == 0) & (j == 0) & first_names_equal)),
                j,
            ),
        )
        hit = F.get(F.array_compact(free), 0)
        return F.when(hit.isNull(), used).otherwise(F.array_append(used, hit))

    indexed = F.transform(a, lambda t, i: F.struct(t.alias("token"), i.alias("position")))
    used = F.aggregate(
        indexed, F.array().cast("array<int>"), lambda acc, x: step(acc, x["token"], x["position"])
    )
    matched = F.size(used)
    union = F.size(a) + F.size(b) - matched
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (union == 0), F.lit(0.0)).otherwise(
        matched.cast("double") / union.cast("double")
    )


def initials(name: Column) -> Column:
    letters = F.transform(F.slice(split_words(name), 1, 2), lambda w: F.left(w, F.lit(1)))
    joined = F.upper(F.array_join(letters, ""))
    return F.when(joined == "", "?").otherwise(joined)
