"""Current states that a question of continuity ("does X still ...") must not be answered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import evidence, identity, scope
from factloom.operators.retrieval import FIELD_STOPWORDS, question_words

#: Fixed values of the rules (word lists in natural order).
ARTICLES = "a an the".split()
META = "independent irrelevant unrelated".split()
META_PHRASE = "preference is"
PROVENANCE_STOPWORDS = [*"a an and are be because for from in is it no of on or that the this to was were with longer".split(), *FIELD_STOPWORDS]


def subject_words(entity: Column) -> Column:
    articles = identity.literal_set(ARTICLES)
    return F.filter(identity.words(entity), lambda w: ~F.array_contains(articles, w))


def traits(states: DataFrame) -> DataFrame:
    """What the rules compare: subject, slot, content words, whether it is a direct assertion or one about relations."""
    subject, said = subject_words(F.col("entity")), identity.words(F.col("span"))
    value = F.col("value").cast("string")
    text = F.lower(F.concat_ws(" ", F.coalesce("span", F.lit("")), "attribute", value))
    content = F.array_except(F.array_except(identity.words(F.concat_ws(" ", value, "span")), identity.words(F.col("entity"))), identity.literal_set(PROVENANCE_STOPWORDS))
    group = [F.col("group_id")] if "group_id" in states.columns else [F.lit(0).alias("group_id")]
    return states.select(
        *group, "state_id", "status", "observation_id", "sequence_index", "observed_at", "t0", "t1", "span",
        F.array_join(subject, " ").alias("subject"),
        identity.attribute_parts(F.coalesce("field", "attribute")).alias("slot"),
        F.coalesce(F.size(identity.words(F.col("field"))) == 1, F.lit(False)).alias("plain"),
        content.alias("content"),
        identity.norm(value).alias("value"),
        ((F.size(subject) > 0) & (F.slice(said, 1, F.greatest(F.size(subject), F.lit(1))) == subject)).alias("direct"),
        (F.arrays_overlap(identity.words(text), identity.literal_set(META)) | F.contains(text, F.lit(META_PHRASE))).alias("meta"),
    )


def shadowed(states: DataFrame, question: str) -> DataFrame:
    """state_id of the CURRENT states that a newer state of the same subject hides; none unless the question asks for continuity.

    states: state_id, entity, attribute, field (canonical, may be null), value, span, observation_id, sequence_index,
    observed_at, t0, t1, status; with a group_id only states of one group are compared. A later STALE state hides one whose time meets its own and whose field is compatible or
    which shares two content words. Another CURRENT state of a compatible field hides one if observed later; within one
    observation only an equal value goes, the earlier of two spans and the later within one span, and a relation about
    the facts and a direct assertion never hide each other. Lifecycle statuses stay as they are.

    One semi join on the subject with both rules as its condition: a live state ends at its first match and no pair is a
    row; AQE deals a subject with very many live states to several tasks. A null entity is no subject.
    """
    if not set(question_words(question)) & set(evidence.CONTINUITY):
        return states.select("state_id").where(F.lit(False))
    t = traits(states.where(F.col("status").isin("CURRENT", "STALE") & F.col("entity").isNotNull()))
    a, b = t.where("status = 'CURRENT'").alias("a"), t.alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    alike = identity.parts_compatible(x("slot"), y("slot"))
    common = F.size(F.array_intersect(x("content"), y("content"))) >= 2
    newer = x("observed_at") < y("observed_at")
    stale = newer & scope.overlaps(x("t0"), x("t1"), y("t0"), y("t1")) & (alike | common)
    together, equal = x("observation_id") == y("observation_id"), x("value") == y("value")
    one_span = F.coalesce((x("span") == y("span")) & (x("span") != ""), F.lit(False))
    apart = (x("meta") & y("direct") & ~y("meta")) | (x("direct") & y("meta") & ~x("meta"))
    within = F.when(one_span, x("sequence_index") > y("sequence_index")).otherwise(x("sequence_index") < y("sequence_index"))
    order = F.when(together, ~apart & equal & within).otherwise(newer)
    live = (x("state_id") != y("state_id")) & order & (alike | (x("plain") & y("plain") & common))
    return a.join(b, (x("group_id") == y("group_id")) & (x("subject") == y("subject")) & F.when(y("status") == "STALE", stale).otherwise(live), "left_semi").select("state_id")
