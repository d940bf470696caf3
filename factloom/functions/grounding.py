"""Grounding of values and attributes in evidence: words by their roots, with one polarity for the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import identity

#: Words that only carry polarity, phrases that negate, derivational endings, cues of polarity and openings.
POLAR_WORDS = "no longer not never without cannot can t isn aren".split()
NEGATION = r"\b(?:not|never|without|no\s+longer|no\s+more|cannot|can't|isn't|aren't)\b"
ENDINGS = "ability ibility ation ition ness ment able ible ity ing ed es s".split()
CONDITIONAL = r"\b(if|unless|when)\b"
NEGATIVE = r"\b(no longer|not|never|unavailable|inactive|failed|closed)\b"
PAST = r"\b(was|were|formerly|previously|used to)\b"
OPENINGS = {
    "greeting": r"^(hi|hello|hey|good morning|good afternoon|good evening)\b",
    "thanks": r"^(thanks|thank you|much appreciated)\b",
    "offer": r"^(let me know if|happy to help|anything else)\b",
}
#: A stem keeps three characters; the shortest stem takes the longest ending.
ROOT = f"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$"


def spaced(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[_-]", " "))


def said(c: Column) -> Column:
    """Words that mean something beyond polarity."""
    return F.filter(identity.words(spaced(c)), lambda w: ~F.array_contains(identity.literal_set(POLAR_WORDS), w))


def denies(w: Column) -> Column:
    return F.startswith(w, F.lit("un")) & (F.length(w) > 4)


def roots(c: Column) -> Column:
    """Distinct roots; a leading "un" is polarity and goes."""
    return F.array_distinct(F.transform(said(c), lambda w: F.regexp_replace(F.when(denies(w), F.substring(w, 3, 1 << 30)).otherwise(w), ROOT, "$1")))


def negative(c: Column) -> Column:
    return spaced(c).rlike(NEGATION) | F.exists(said(c), denies)


def meaning(c: Column) -> Column:
    """roots and negative of a text; give it a column of its own, so that it is computed once for all the tests below."""
    return F.struct(roots(c).alias("roots"), negative(c).alias("negative"))


def value_grounded(value: Column, evidence: Column) -> Column:
    """All roots of the value are in the evidence, with the same polarity (both are meanings)."""
    return (F.size(value["roots"]) > 0) & (F.size(F.array_except(value["roots"], evidence["roots"])) == 0) & (value["negative"] == evidence["negative"])


def polarity_conflicts(value: Column, evidence: Column) -> Column:
    return F.arrays_overlap(value["roots"], evidence["roots"]) & (value["negative"] != evidence["negative"])


def attribute_grounded(attribute: Column, evidence: Column, said_of: Column) -> Column:
    """A root in common with the evidence's meaning ``said_of``, or the name in the evidence as it stands."""
    return F.arrays_overlap(roots(attribute), said_of["roots"]) | F.contains(F.lower(evidence), F.regexp_replace(attribute, "_", " "))


def grounded_conditions(conditions: Column, evidence: Column) -> Column:
    """Conditions (key, value) that the evidence names by key and value."""
    text = F.lower(evidence)
    return F.filter(conditions, lambda x: F.contains(text, F.lower(x["key"])) & F.contains(text, F.lower(x["value"])))


def polarity(evidence: Column) -> Column:
    t = F.lower(F.coalesce(evidence, F.lit("")))
    return F.when(t.rlike(CONDITIONAL), "conditional").when(t.rlike(NEGATIVE), "negative").when(t.rlike(PAST), "historical").otherwise("positive")


def opening(evidence: Column) -> Column:
    """The kind of a sentence that is about the talk itself; null for others."""
    t = F.lower(F.trim(F.coalesce(evidence, F.lit(""))))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(OPENINGS.items()):
        kind = F.when(t.rlike(pattern), name).otherwise(kind)
    return kind
