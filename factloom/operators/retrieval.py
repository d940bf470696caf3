"""Ranking of states for a question, and checking of the premises in it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import evidence, identity

#: Fixed values of the question syntax (word lists in natural order).
FIELD_STOPWORDS = "a an and are did do does for from how i in is many me much my of or the to was were what when where which who why with your".split()
GENERIC = "can current do does is live lives located status what where which who should still".split()
SYNTAX = [*FIELD_STOPWORDS, *GENERIC, *"based conversation history still remain remains continue continues yet anymore on as about after before during into over than through under while user person people someone somebody they them their since has have had been being last few years can could would should recommend sign up right now specific".split()]
FIELD_SYNTAX = [*FIELD_STOPWORDS, *"based conversation history still remain remains continue continues yet anymore user person people someone somebody they them their live on at by in into onto upon since has have had been being last few years can could would should recommend sign up right now specific this tasks task week today".split()]
PERSONS = "user person people someone somebody".split()


def question_words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def field_words(text: str) -> list[str]:
    """Words of a field label; a compound with a function word in it also in one piece."""
    out: list[str] = []
    for raw in re.findall(r"\w+(?:[_-]\w+)*", text.lower()):
        parts = re.split("[_-]+", raw)
        if len(parts) > 1 and any(p in FIELD_STOPWORDS for p in parts) and "".join(parts) not in FIELD_STOPWORDS:
            out.append("".join(parts))
        out += [p for p in parts if p not in FIELD_STOPWORDS]
    return list(dict.fromkeys(x for x in out if x))


def intents(query: str) -> list[str]:
    """Clauses of a question that ask for different fields."""
    parts = [p.strip(" ,，。") for p in re.split(r"(?:[;；!?！？]+|\s+(?:and|or)\s+|(?:以及|并且|或者|或))", query, flags=re.I)]
    return list({tuple(field_words(p)): p for p in reversed(parts) if field_words(p)}.values())[::-1] or ([query.strip()] if query.strip() else [])


def field_array(c):
    """field_words of a column of labels with at most one separator between words."""
    parts = F.filter(F.split(F.lower(c), r"[\s_-]+"), lambda w: w != "")
    plain = F.filter(parts, lambda w: ~F.array_contains(identity.literal_set(FIELD_STOPWORDS), w))
    compact = F.when(F.lower(c).rlike("[_-]") & (F.size(plain) < F.size(parts)), F.array(F.array_join(parts, ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(compact, plain))


def scored(states: DataFrame, query: str, evidence_ids: list[str] | None = None) -> DataFrame:
    """states (entity, attribute, value, description, span, evidence_id) with the six parts of the score and the sum.

    The question is one scalar, so its words are literals; everything on the rows' side stays in expressions.
    """
    asked = question_words(query)
    lit = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")
    content = lit(list(dict.fromkeys(w for w in asked if w not in SYNTAX)))
    text = F.lit(" ".join(asked))
    entity = identity.words(F.col("entity"))
    named = (F.size(entity) > 0) & F.contains(text, F.array_join(entity, " "))
    s = states.select("*", named.alias("_named"), entity.alias("_entity"))
    own = F.when(F.col("_named"), F.col("_entity")).otherwise(F.array().cast("array<string>"))
    syntax = identity.literal_set(SYNTAX)
    clean = lambda ws: F.array_except(F.array_except(F.array_distinct(ws), syntax), own)
    spoken = F.concat_ws(" ", "entity", F.regexp_replace("attribute", r"[_\-\s]+", " "), F.col("value").cast("string"), F.coalesce("description", F.lit("")))
    said = identity.words(F.col("span"))
    s = s.select("*", F.array_except(content, own).alias("_ask"), clean(identity.words(spoken)).alias("_state"), clean(said).alias("_said"), said.alias("_span"))
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    jaccard = lambda a, b: shared(a, b) / F.greatest(F.lit(1), F.size(a) + F.size(b) - shared(a, b))
    lexical = jaccard(F.col("_ask"), F.col("_state"))
    goes_on, person = bool(set(asked) & set(evidence.CONTINUITY)), bool(set(asked) & set(PERSONS))
    quoted = jaccard(F.col("_ask"), F.col("_said"))
    if goes_on and person:
        quoted = F.when(F.col("_named"), quoted).otherwise(0.0)
    fields = []
    for intent in intents(query):
        want = [w for w in field_words(intent) if w not in FIELD_SYNTAX]
        if want:
            fields.append(shared(lit(want), field_array(F.col("attribute"))) / len(want))
    field = F.greatest(*fields, F.lit(0.0)) if fields else F.lit(0.0)
    subject = F.array_except(F.col("_entity"), lit(["a", "an", "the"]))
    opens = (F.size(subject) > 0) & (F.slice("_span", 1, F.greatest(F.size(subject), F.lit(1))) == subject)
    direct = F.when(F.lit(goes_on) & opens & (shared(F.col("_ask"), F.array_union("_state", "_said")) > 0), 0.2).otherwise(0.0)
    specific = F.size(F.array_except("_ask", lit(GENERIC))) > 0
    s = s.select("*", F.when(F.col("evidence_id").isin(evidence_ids or []), 0.5).otherwise(0.0).alias("graph_score"), lexical.alias("lexical_score"), quoted.alias("evidence_score"), field.alias("field_score"), direct.alias("direct_score"), specific.alias("_specific"))
    anchor = F.when(F.col("_named") & ((F.col("lexical_score") > 0) | (F.col("field_score") > 0) | ~F.col("_specific")), 2.0).otherwise(0.0)
    s = s.withColumn("subject_score", anchor)
    parts = ["graph_score", "lexical_score", "evidence_score", "field_score", "direct_score", "subject_score"]
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return s.select(*states.columns, *[F.round(p, 6).alias(p) for p in parts], F.round(total, 6).alias("score"))


def checked(premises: DataFrame, states: DataFrame) -> DataFrame:
    """query_id, premise_id, verdict, policy.

    premises: query_id, premise_id, entity, attribute, expected. states: entity, attribute, value, status. A current
    value other than the expected one is a conflict and beats support; a stale match alone is a conflict too. The policy
    is that of the whole question: any conflict rejects it, nothing but unverified premises asks back.
    """
    at = states.groupBy("entity", "attribute").agg(
        F.collect_set(F.when(F.col("status") == "CURRENT", F.col("value"))).alias("current"),
        F.bool_or(F.col("status") == "STALE").alias("was"),
    )
    p = premises.join(at, ["entity", "attribute"], "left")
    other = F.exists("current", lambda v: v != F.col("expected"))
    verdict = (
        F.when(F.coalesce(other, F.lit(False)), "CONFLICTED")
        .when(F.coalesce(F.array_contains("current", F.col("expected")), F.lit(False)), "SUPPORTED")
        .when(F.col("was"), "CONFLICTED")
        .otherwise("UNVERIFIED")
    )
    p = p.select("query_id", "premise_id", verdict.alias("verdict"))
    all_ = p.groupBy("query_id").agg(F.bool_or(F.col("verdict") == "CONFLICTED").alias("bad"), F.bool_and(F.col("verdict") == "UNVERIFIED").alias("none"))
    policy = F.when(F.col("bad"), "REJECT_STALE_PREMISE").when(F.col("none"), "CLARIFY").otherwise("PROCEED")
    return p.join(all_, "query_id").select("query_id", "premise_id", "verdict", policy.alias("policy"))
