"""What an evidence span says about a state: polarity, overlap, directness, causal markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.identity import literal_set, words

#: Fixed values of the evidence rules (word lists in natural order).
REVOKED = ["no longer", "no more", "unavailable", "disabled", "stopped", "ceased", "cancelled", "canceled", "revoked", "withdrawn"]
LINK_STOPWORDS = "a an and are as at be because by for from has have in is it of on or that the to was were with this these those no longer".split()
TEMPORAL_WORDS = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december today tomorrow yesterday morning afternoon evening night".split()
CAUSAL = "because while when if after before due since that".split()
NEGATIVE = "not no never cannot unable unavailable invalidated cancelled canceled impossible".split()
INDEPENDENT = r"\b(?:unrelated|independent|separately|separate)\b"
CONTINUITY = "still remain remains continue continues yet anymore".split()
MARKER = r"\b(?:because|requires?|only\s+(?:if|when)|provided\s+that|after|without|unless|derived\s+from|computed\s+from|calculated\s+from|inferred\s+from|summar(?:y|ized)\s+from|based\s+on|depends?\s+on|relies?\s+on|necessary\s+for)\b"
PROVENANCE = r"\b(?:because|due\s+to|requires?|is\s+required\s+for|depends?\s+on|relies?\s+on|only\s+(?:if|when|while)|provided\s+that|unless|without|derived\s+from|computed\s+from|calculated\s+from|inferred\s+from|based\s+on|causes?|leads?\s+to|enables?|may\s+affect|might\s+affect|could\s+affect|affects?|results?\s+in|necessary\s+for|prerequisite\s+for)\b"
CAUSAL_CLAUSE = r"\b(?:because|requires?|only\s+(?:if|when)|provided\s+that|after)\b"
DERIVATION = r"\b(?:derived\s+from|computed\s+from|calculated\s+from|inferred\s+from|summar(?:y|ized)\s+from|based\s+on)\b"
ACTION_CUE = r"\b(?:action|plan|schedule|scheduled|execute|execution|proceed|deploy|reserve|reserved|book|arrange|arranged)\b"
PRECONDITION = r"\b(?:requires?|without|unless|must|only\s+(?:if|when))\b"
ACTION_ROLE = r"\b(?:action|plan|planned|schedule|scheduled|appointment|meeting|workshop|deployment|deploy|execute|execution|proceed|reserve|reserved|booking|booked|arrange|arranged|feasible|feasibility|task)\b"
DECISION_ROLE = r"\b(?:decision|decide|eligibility|eligible|approval|approved|authorize|authorized|authorization|permit|permitted|deny|denied|reject|rejected)\b"
DERIVED_ROLE = r"\b(?:derived|computed|calculated|inferred|summar(?:y|ized)|conclusion|result|outcome|deduced)\b"


def has(text: Column, pattern: str) -> Column:
    return F.lower(text).rlike(pattern)


def revoked(*texts: Column) -> Column:
    """Any strong word of revocation in the evidence, the attribute or the value."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(t.cast("string"), F.lit("")) for t in texts]))
    return F.exists(literal_set(REVOKED), lambda w: F.contains(text, w))


def negative(*texts: Column) -> Column:
    text = F.concat_ws(" ", *texts)
    return F.arrays_overlap(words(text), literal_set(NEGATIVE)) | F.contains(F.lower(text), F.lit("no longer"))


def overlap(a: Column, b: Column, *subjects: Column) -> Column:
    """Distinct words that two spans share, without link words and the subjects' own."""
    return shared(words(a), words(b), *[words(s) for s in subjects])


def shared(a: Column, b: Column, *subjects: Column) -> Column:
    """``overlap`` of texts of which the words are known."""
    return F.size(F.array_except(F.array_intersect(a, b), F.concat(literal_set(LINK_STOPWORDS), *subjects)))


def temporal_tokens(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.array_distinct(F.concat(F.array_intersect(words(c), literal_set(TEMPORAL_WORDS)), F.regexp_extract_all(text, F.lit(r"\b\d{1,4}(?:[:/-]\d{1,4})+\b"), F.lit(0))))


def temporal_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(temporal_tokens(a), temporal_tokens(b)))


def directness(span: Column, subject: Column) -> Column:
    """-1 without the subject, -2 after a causal word, 2 in the first quarter, else 0.5."""
    text, who = F.trim(F.coalesce(span, F.lit(""))), F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    at = F.instr(F.lower(text), who) - 1
    causal = F.lower(F.substring(text, F.lit(1), at)).rlike(r"\b(?:" + "|".join(CAUSAL) + r")\b")
    near = at <= F.greatest(F.lit(4), F.floor(F.length(text) / 4))
    return F.when((text == "") | (who == "") | (at < 0), -1.0).when(causal, -2.0).when(near, 2.0).otherwise(0.5)


def role(entity: Column, attribute: Column, value: Column) -> Column:
    """UNKNOWN, DERIVED_STATE, DECISION, ACTION_OR_PLAN or ORDINARY_FACT, first match wins."""
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    text = F.lower(F.concat_ws(" ", entity, attribute, value.cast("string")))
    return F.when(blank(entity) | blank(attribute) | blank(value), "UNKNOWN").when(text.rlike(DERIVED_ROLE), "DERIVED_STATE").when(text.rlike(DECISION_ROLE), "DECISION").when(text.rlike(ACTION_ROLE), "ACTION_OR_PLAN").otherwise("ORDINARY_FACT")


def relation_type(span: Column) -> Column:
    """Type of a directional candidate by the wording of its evidence; null without a marker."""
    t = F.lower(F.coalesce(span, F.lit("")))
    return F.when(~t.rlike(MARKER), None).when(t.rlike(DERIVATION), "derived-from").when(t.rlike(ACTION_CUE) & t.rlike(PRECONDITION), "affects-action").otherwise("depends-on")


def continuity(query: Column) -> Column:
    return F.arrays_overlap(words(query), literal_set(CONTINUITY))
