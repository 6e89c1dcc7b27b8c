"""Words and phrases of labels, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and ``+ # .``."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9+#.]+"), lambda t: t != "")


def padded(text: Column) -> Column:
    """The words of a text between single spaces, so that a phrase is found by ``contains``."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` follow one another in ``text``; never for an empty phrase."""
    return (F.size(tokens(phrase)) > 0) & padded(text).contains(padded(phrase))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a lower-case text has one of the words anywhere."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def word(pattern: str) -> str:
    """A pattern between ASCII word boundaries, whatever ``\\b`` means to the regex engine."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def label(text: Column) -> Column:
    """A category label as it is compared: lower case, letters, digits, white space and hyphens only."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", ""))


def experience(title: Column) -> Column:
    """Experience level by the words of a title."""
    t = F.lower(title)
    has = lambda p: t.rlike(word(p))
    return (
        F.when(title.isNull() | (title == ""), "UNKNOWN")
        .when(has("intern|graduate|trainee|apprentice"), "INTERN")
        .when(has("junior|entry|associate|i") & ~has("senior|lead"), "ENTRY")
        .when(has("principal|head|director|vp|chief|staff"), "LEAD")
        .when(has("senior|lead|sr"), "SENIOR")
        .otherwise("UNKNOWN")
    )


def employment(raw: Column) -> Column:
    """Employment type by the first known part of a text."""
    t = F.lower(raw)
    return (
        F.when(raw.isNull(), "UNKNOWN")
        .when(t.contains("part"), "PART_TIME")
        .when(t.contains("contract") | t.contains("freelance"), "CONTRACT")
        .when(t.contains("intern"), "INTERNSHIP")
        .when(t.contains("temp"), "TEMPORARY")
        .when(t.contains("full"), "FULL_TIME")
        .otherwise("UNKNOWN")
    )


def known_skills(text: Column, names: Iterable[str], most: int = 8) -> Column:
    """The first ``most`` of the names that a text contains, whatever their case."""
    t = F.lower(text)
    return F.slice(F.filter(F.array(*map(F.lit, names)), lambda n: t.contains(F.lower(n))), 1, most)


def band(score: Column) -> Column:
    """Label of a score."""
    return F.when(score >= 90, "Excellent").when(score >= 80, "Strong").when(score >= 70, "Good").when(score >= 60, "Possible").otherwise("Weak")
