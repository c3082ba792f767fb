"""Scores out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key before a score, and what counts as one (quoted or bare). ASCII blanks and digits.
SCORE_KEY = r'(?:\\?"score\\?"|score)\s*:\s*'
SCORE_VALUE = r"Response 1|Response 2|true|false|True|False|\d+(?:\.\d+)?"
SCORE_PATTERN = rf'{SCORE_KEY}("(?:{SCORE_VALUE})"|(?:{SCORE_VALUE}))'
NUMBER = r"^0*(\d+)(?:\.\d+)?$"


def extract_score(text: Column) -> Column:
    """The first score in a text, as a string: words verbatim, numbers truncated and without leading zeros; null if none."""
    found = F.translate(F.regexp_extract(text, SCORE_PATTERN, 1), '"', "")
    return F.nullif(F.regexp_replace(found, NUMBER, "$1"), F.lit(""))


def int_score(text: Column) -> Column:
    """The score as an int; null where there is none, where it is a word, or where it is out of range."""
    return extract_score(text).try_cast("int")


def matches(answer: Column, truth: Column, how: str = "exact") -> Column:
    """Whether an answer equals the truth: ``exact`` or ``casefold`` on strings, ``int`` on numbers; a null never matches."""
    a, g = answer.cast("string"), truth.cast("string")
    if how == "casefold":
        a, g = F.lower(a), F.lower(g)
    elif how == "int":
        a, g = a.try_cast("int"), g.try_cast("int")
    elif how != "exact":
        raise ValueError(f"unknown match {how!r}: exact, casefold or int")
    return F.coalesce(a == g, F.lit(False))
