"""String expressions: folding, trimming, tokens, keys, hashes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Python-style whitespace; plain \s is ASCII only on the JVM.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it per element."""
    return F.get(F.transform(F.array(value), body), 0)


def text(col: Column | str) -> Column:
    """Missing text is the empty string everywhere in this library."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(text(col)), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First non-empty value, else the empty string; values are not trimmed."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cols], F.lit(""))


# The same characters as a set to trim; trimming looks at the ends only, a pattern would
# walk the whole text.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(col: Column) -> Column:
    return F.trim(text(col), F.lit(SPACES))


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(text(col), f"{SPACE}+", " "))


def strip_controls(col: Column) -> Column:
    """Drop C0 controls and DEL, keeping tab, line feed and carriage return."""
    return F.regexp_replace(text(col), CONTROL_CHARS, "")


def strip_controls_map(col: Column) -> Column:
    return F.transform_values(col, lambda _k, v: strip_controls(v))


def strip_controls_array(col: Column) -> Column:
    return F.transform(col, strip_controls)


@lru_cache
def _folding(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Character table for a decomposition form, derived from the Unicode data."""
    source, target, wide = [], [], []
    blocks = [(0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFB00, 0xFB07), (0xFF00, 0xFF5F)]
    for low, high in blocks:
        for code in range(low, high):
            char = chr(code)
            base = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))
            if base == char or not base:
                continue
            if len(base) == 1:
                source.append(char)
                target.append(base)
            elif base.isalpha():
                wide.append((char, base))
    return "".join(source), "".join(target), tuple(wide)


def strip_accents(col: Column, form: str = "NFKD") -> Column:
    """Fold accents: ``NFD`` for canonical letters, ``NFKD`` also for ligatures and widths."""
    source, target, wide = _folding(form)
    folded = F.translate(text(col), source, target)
    if wide:
        spelled = folded
        for char, base in wide:
            spelled = F.replace(spelled, F.lit(char), F.lit(base))
        folded = F.when(folded.rlike("[" + "".join(c for c, _ in wide) + "]"), spelled).otherwise(folded)
    return F.regexp_replace(folded, r"\p{Mn}", "")


def fold(col: Column, form: str = "NFKD") -> Column:
    return F.lower(strip_accents(col, form))


def has_any(col: Column, needles: list[str]) -> Column:
    """True when ``col`` contains one of a fixed list of substrings."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(col, F.lit(needle))
    return found


def first_label(col: Column, table: list[tuple[str, str]], default: str | None, test: str = "contains") -> Column:
    """Label of the first entry that matches; ``test`` is contains, prefix or regex."""
    tests = {
        "contains": lambda needle: F.contains(col, F.lit(needle)),
        "prefix": lambda needle: F.startswith(col, F.lit(needle)),
        "regex": lambda needle: col.rlike(needle),
    }
    branch = F
    for needle, label in table:
        branch = branch.when(tests[test](needle), F.lit(label))
    return branch.otherwise(F.lit(default))


def word_tokens(col: Column) -> Column:
    """Maximal runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(text(col), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def ascii_words(col: Column, shortest: int) -> Column:
    """Lower-case words made of a-z only, at least ``shortest`` long, in order."""
    word = r"(?<![\p{L}\p{N}_])([a-z]{%d,})(?![\p{L}\p{N}_])" % shortest
    return F.regexp_extract_all(F.lower(text(col)), F.lit(word), F.lit(1))


def split_words(col: Column) -> Column:
    """Whitespace split without empty parts."""
    return F.filter(F.split(squeeze(col), " "), lambda w: w != "")


def snake_case(col: Column) -> Column:
    snake = F.regexp_replace(F.lower(trim_all(col)), "[^a-z0-9]+", "_")
    return first_filled(F.trim(snake, F.lit("_")), F.lit("field"))


def title_case_label(col: Column) -> Column:
    """``call_notes`` to ``Call Notes``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def clip(col: Column, chars: int) -> Column:
    return F.left(text(col), F.lit(chars))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, zero for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.bround(F.lit(100.0) * part.cast("double") / whole.cast("double"), 1)
    )


def guarded_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def avatar_key(email: Column) -> Column:
    return F.md5(F.lower(trim_all(email)))


def prompt_hash(*parts: Column) -> Column:
    """Short digest of everything a score depends on; parts are kept apart by a control mark."""
    joined = F.concat_ws("\x1f", *[text(p) for p in parts])
    return F.left(F.sha2(joined, 256), F.lit(16))
