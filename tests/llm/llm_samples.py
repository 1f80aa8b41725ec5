"""Small texts and tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, block long, label string, ids string, n long"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def edited(text: str, at: int) -> str:
    words = text.split()
    words[at] = "edited"
    return " ".join(words)


def rows(texts: list) -> list:
    """Documents 0, 1, ... with columns whose names clash with those the operators use."""
    return [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t) if t else None, "x", 7, "y", "z", 1)
            for i, t in enumerate(texts)]
