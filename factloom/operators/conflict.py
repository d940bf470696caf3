"""Conflict classification of state pairs and the revision that follows from it.

``pairs`` hold a new state in columns n_* and an old one in columns o_*: state_id, entity, attribute, value, t0, t1 (validity),
cond (sorted key/value structs), confidence, observed_at, observation_index, sequence_index, span; the new one also
n_effects (selectors), n_invalidates and n_conflicts (ids). ``linked`` says that linking has settled the slot already.
"""

from __future__ import annotations

from operator import eq, ne

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import evidence, identity, scope

UNCERTAIN_BELOW = 0.5
FAR = (1 << 63) - 1


def same_scope() -> Column:
    n, o = (scope.semantic_scope(F.col(f"{p}_t0"), F.col(f"{p}_t1"), F.col(f"{p}_observed_at")) for p in "no")
    return n[0].eqNullSafe(o[0]) & n[1].eqNullSafe(o[1]) & (F.col("n_cond") == F.col("o_cond"))


def same_slot() -> Column:
    """Same subject, compatible attributes, same scope."""
    subject = identity.norm(F.col("n_entity").cast("string")) == identity.norm(F.col("o_entity").cast("string"))
    return subject & identity.attributes_compatible(F.col("n_attribute"), F.col("o_attribute")) & same_scope()


def provenance_order(columns=()) -> Column:
    """1 or -1 where observation order, then order within the observation, tells; else 0.

    Where ``columns`` have observation ids, equal ones tell the order within them also without indexes.
    """
    first, then = (F.signum(F.col(f"n_{c}") - F.col(f"o_{c}")) for c in ("observation_index", "sequence_index"))
    known = F.col("n_observation_index").isNotNull() & F.col("o_observation_index").isNotNull()
    together = F.coalesce(F.col("n_observation_id") == F.col("o_observation_id"), F.lit(False)) if "n_observation_id" in columns else F.lit(False)
    return F.when(known & (first != 0), first).when(known | together, then).otherwise(F.lit(0)).cast("int")


def classified(pairs: DataFrame) -> DataFrame:
    """pairs with ``conflict`` and ``conflict_confidence``; the first rule that matches wins."""
    n, o = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"o_{c}"))
    effect = F.exists("n_effects", lambda s: scope.selected(o("entity"), o("attribute"), o("value"), s["entity"], s["attribute"], s["value"]))
    named = F.array_contains("n_conflicts", o("state_id"))
    slot = F.col("linked") | same_slot()
    # what is read off one state alone may be there already (see ``linking.read_once``)
    once = lambda c, make: [F.col(f"{p}_{c}") if f"{p}_{c}" in pairs.columns else make(x) for p, x in (("n", n), ("o", o))]
    value = eq(*once("value_key", lambda x: identity.state_value(x("attribute"), x("value"))))
    open_ended = (n("cond") == o("cond")) & n("t1").isNull() & o("t1").isNull()
    bounded = scope.contains(o("t0"), o("t1"), n("t0"), n("t1")) & ~(n("t0").eqNullSafe(o("t0")) & n("t1").eqNullSafe(o("t1"))) & n("t1").isNotNull() & (o("t1").isNull() | (n("t1") < o("t1")))
    flipped = ne(*once("revoked", lambda x: evidence.revoked(x("span"), x("attribute"), x("value"))))
    order = F.col("_order")
    marked = pairs.select("*", slot.alias("_slot"), value.alias("_value"), provenance_order(pairs.columns).alias("_order"))
    slot, value = F.col("_slot"), F.col("_value")
    kind = (
        F.when(F.array_contains("n_invalidates", o("state_id")) | effect, "IMPLICIT_INVALIDATION")
        .when(~F.col("linked") & ~scope.overlaps(n("t0"), n("t1"), o("t0"), o("t1")), "CONSISTENT")
        .when(~F.col("linked") & ~scope.conditions_overlap(n("cond"), o("cond")), "CONSISTENT")
        .when(~slot & ~named, "CONSISTENT")
        .when(slot & value & (same_scope() | open_ended), "DUPLICATE")
        .when(slot & value, "CONSISTENT")
        .when(slot & flipped, "POLARITY_CONFLICT")
        .when(slot & (bounded | scope.more_specific(n("cond"), o("cond"))), "TEMPORARY_EXCEPTION")
        .when(order > 0, "UPDATE")
        .when(order < 0, "UNCERTAIN")
        .when(n("observed_at") > o("observed_at"), "UPDATE")
        .when(n("observed_at") < o("observed_at"), "UNCERTAIN")
        .when(n("confidence") < UNCERTAIN_BELOW, "UNCERTAIN")
        .otherwise("EXPLICIT_CONFLICT")
    )
    both = F.least(n("confidence"), o("confidence"))
    sure = F.when(F.col("conflict").isin("CONSISTENT", "DUPLICATE"), 1.0).when(F.col("conflict").isin("POLARITY_CONFLICT", "EXPLICIT_CONFLICT"), both).otherwise(n("confidence"))
    out = marked.withColumn("conflict", kind).withColumn("conflict_confidence", sure)
    polarity = F.col("conflict") == "POLARITY_CONFLICT"
    return out.withColumn("polarity", polarity).withColumn("conflict", F.when(polarity, "EXPLICIT_CONFLICT").otherwise(F.col("conflict"))).drop("_slot", "_value", "_order")


def revised(decisions: DataFrame) -> DataFrame:
    """n_state_id, o_state_id, conflict, edge, o_status, n_status, duplicate_of of classified pairs (o_status in, null: CURRENT).

    One window over a new state's links: a current duplicate ends it (the winner merges, other duplicates become
    HISTORICAL; of several the one of the same attribute, the first place in its source where there is a column
    o_span_start, and the first observation wins); else each link brings its own edge and status and together they decide the new state's.
    """
    w = W.partitionBy("n_state_id")
    was = F.coalesce("o_status", F.lit("CURRENT"))
    d = decisions.withColumn("was", was)
    duplicate = (F.col("conflict") == "DUPLICATE") & (F.col("was") == "CURRENT")
    place = F.coalesce("o_span_start", F.lit(FAR)) if "o_span_start" in decisions.columns else F.lit(FAR)
    rank = F.struct((F.lower("o_attribute") != F.lower("n_attribute")).cast("int").alias("a"), place.alias("s"), F.coalesce("o_observation_index", F.lit(FAR)).alias("b"), F.col("o_sequence_index").alias("c"), F.col("o_state_id").alias("d"))
    d = d.withColumn("winner", F.min(F.when(duplicate, rank)).over(w)["d"])
    is_ = lambda *k: F.col("conflict").isin(*k)
    fells = is_("UPDATE", "IMPLICIT_INVALIDATION") | (is_("EXPLICIT_CONFLICT") & (F.col("polarity") | (F.col("n_confidence") > F.col("o_confidence"))))
    d = d.withColumn("falls", fells)
    doubt = F.bool_or(is_("UNCERTAIN") | (is_("EXPLICIT_CONFLICT") & ~F.col("falls"))).over(w)
    ruled = F.bool_or(is_("UPDATE", "IMPLICIT_INVALIDATION")).over(w)
    merges = F.col("winner").isNotNull()
    edge = F.when(merges, None).when(is_("UPDATE", "TEMPORARY_EXCEPTION"), "updates").when(F.col("falls"), "invalidates")
    ended = is_("CONSISTENT") & (F.col("o_t1") <= F.col("n_observed_at"))
    old = (
        F.when(merges & duplicate & (F.col("o_state_id") != F.col("winner")), "HISTORICAL")
        .when(merges | (F.col("was") != "CURRENT"), F.col("was"))
        .when(F.col("falls"), "STALE")
        .when(ended, "HISTORICAL")
        .otherwise(F.col("was"))
    )
    new = F.when(merges, "MERGED").when(doubt | ((F.col("n_confidence") < UNCERTAIN_BELOW) & ~ruled), "UNCERTAIN").otherwise("CURRENT")
    kind = F.when(merges, None).when(doubt, "unresolved_conflict").when((F.col("n_confidence") < UNCERTAIN_BELOW) & ~ruled, "low_confidence")
    return d.select("n_state_id", "o_state_id", "conflict", edge.alias("edge"), old.alias("o_status"), new.alias("n_status"), kind.alias("uncertainty_kind"), F.col("winner").alias("duplicate_of"))


def suppressed(states: DataFrame, query_words: list[str]) -> DataFrame:
    """Broad states that a narrower one of the same subject overrides: state_id, by.

    Attributes must be compatible and values differ, and either the narrow conditions are strictly more and all their
    values' words are in the query, or the broad interval contains another, narrower one. An equi join on the subject and
    what compatible attributes have in common; a pair may meet at several keys, which the least ``by`` doesn't mind. What
    is read off one state alone is read before the join.
    """
    cols = ["state_id", "value", "t0", "t1", "cond", "parts"]
    s = states.withColumn("parts", identity.attribute_parts(F.col("attribute")))
    side = lambda p, *more: s.select("entity", F.explode(identity.attribute_keys(F.col("parts"))).alias("key"), *[F.col(c).alias(f"{p}_{c}") for c in cols], *more)
    b, n = (lambda c: F.col(f"b_{c}")), (lambda c: F.col(f"n_{c}"))
    spoken = identity.literal_set(query_words)
    words = F.flatten(F.transform("cond", lambda c: identity.words(c["value"])))
    told = n("told") & scope.more_specific(n("cond"), b("cond"))
    inside = scope.contains(b("t0"), b("t1"), n("t0"), n("t1")) & ~(b("t0").eqNullSafe(n("t0")) & b("t1").eqNullSafe(n("t1")))
    narrow = side("n", ((F.size("cond") > 0) & (F.size(F.array_except(words, spoken)) == 0)).alias("n_told"))
    pairs = side("b").join(narrow, ["entity", "key"]).where((b("state_id") != n("state_id")) & (b("value") != n("value")))
    hit = pairs.where((inside | told) & identity.parts_compatible(b("parts"), n("parts")))
    return hit.groupBy(b("state_id").alias("state_id")).agg(F.min(n("state_id")).alias("by"))
