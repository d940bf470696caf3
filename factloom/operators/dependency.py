"""Typing, guarding and choosing of dependency candidates, and the cascade over typed edges."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import evidence, identity
from factloom.sources.durable import cut

#: Signals that give a candidate a direction without a marker in its evidence (fixed values).
DIRECTIONAL = ["used_by_relation", "derived_claim_relation", "action_precondition", "explicit_source_relation", "explicit_semantic_relation", "existing_semantic_relation", "causal_text_grounding"]
STOPWORDS = "a an and are as at be because by for from has have if in is it of on only or provided that the to was when which with".split()


def content_words(c):
    return F.filter(F.array_except(F.array_distinct(identity.words(c)), identity.literal_set(STOPWORDS)), lambda w: F.length(w) > 1)


def source_clause(span):
    """The evidence from its first marker on; the whole where the marker is "after"; empty without one."""
    tail = F.regexp_extract(span, "(?is)(" + evidence.MARKER + ".*)$", 1)
    return F.when(F.lower(F.ltrim(tail)).startswith("after"), span).otherwise(tail)


def typed(candidates: DataFrame) -> DataFrame:
    """candidates with relation_type and reason; null type is a rejection.

    candidates: span, signals (array), src_entity, src_attribute, src_observation, src_span, dst_entity, dst_attribute,
    dst_observation, dst_span.
    """
    span = F.coalesce("span", F.lit(""))
    kind = evidence.relation_type(span)
    marked = kind.isNotNull()
    slot = (F.lower(F.trim("src_entity")) == F.lower(F.trim("dst_entity"))) & (F.lower(F.trim("src_attribute")) == F.lower(F.trim("dst_attribute")))
    grounded = F.arrays_overlap(content_words(source_clause(span)), content_words(F.col("src_entity")))
    one_span = (F.col("src_observation") == F.col("dst_observation")) & (F.coalesce("src_span", F.lit("")) != "") & (F.lower("src_span") == F.lower("dst_span"))
    reason = (
        F.when(slot, "same slot")
        .when(~marked & ~F.arrays_overlap("signals", identity.literal_set(DIRECTIONAL)), "no direction")
        .when(marked & ~grounded, "source not in clause")
        .when(one_span, "same evidence")
    )
    return candidates.select("*", F.when(reason.isNull(), F.coalesce(kind, F.lit("depends-on"))).alias("relation_type"), reason.alias("reason"))


def semantics_valid(strength, counterfactual, *required):
    """All required guards hold, STRICT has a counterfactual, WEAK explicitly none."""
    ok = F.lit(True)
    for r in required:
        ok = ok & F.coalesce(r, F.lit(False))
    return ok & F.coalesce(F.when(strength == "STRICT", counterfactual).when(strength == "WEAK", ~counterfactual), F.lit(False))


def antisymmetric(assessed: DataFrame) -> DataFrame:
    """Of A->B and B->A the stronger stays: strength, confidence, number of signals, then the smaller source."""
    w = W.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy(F.desc("strength"), F.desc("confidence"), F.desc("n_signals"), "source", "target")
    return assessed.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def competing(candidates: DataFrame) -> DataFrame:
    """candidates with ``kept``: of one dependent's candidates those stay that no eligible one beats.

    candidates: dependent, eligible (its entity is in the source clause), overlap, state_order, position; greater wins.
    """
    rank = F.struct("overlap", "state_order", "position")
    best = F.max(F.when(F.col("eligible"), rank)).over(W.partitionBy("dependent"))
    return candidates.select("*", F.coalesce(rank >= best, F.lit(True)).alias("kept"))


ACTIVE = ["CURRENT", "UNCERTAIN"]
#: So many levels are gathered before they are written as one, which keeps plans short on deep graphs.
LEVELS = 12


def propagate(states: DataFrame, edges: DataFrame, seeds: DataFrame, protected: DataFrame) -> DataFrame:
    """state_id, version, depth, via, root, outcome of a cascade through dependencies.

    states: state_id, version (states of one version fall together), status. edges: source, target (state ids), strength;
    seeds and protected: state_id. Level by level from the seeds' versions: a STRICT edge takes its target's version
    along and goes on from it, also where it was no longer active. A protected version (a replacement that this
    transaction brought) is taken only where another STRICT source supports it independently, one that is CURRENT and
    hasn't been reached up to this level; else it stays (PROTECTED) and nothing goes on from it. A WEAK edge of a version
    that has fallen marks its target (REVALIDATE) and never goes on; STRICT wins over WEAK. Active states (CURRENT,
    UNCERTAIN) of a fallen version become STALE (SEED: of the seeds'), others are PASSED. ``via`` is the least source
    version of the first level that reached a version, ``root`` the least seed version among those that did. Unknown
    states in edges, seeds or protected are left out. It ends when a level brings nothing new: cycles end, no depth limit.

    Edges are dealt by source once; a level joins its frontier with them, so it costs what it reaches.
    """
    nodes = states.select("state_id", "version", "status")
    version = lambda end: nodes.select(F.col("state_id").alias(end), F.col("version").alias(f"{end}_version"))
    linked = edges.join(version("source"), "source").join(version("target"), "target")
    linked = linked.where("source_version <> target_version").select(F.col("source_version").alias("from"), F.col("target_version").alias("to"), "strength", "source")
    linked = cut(linked.repartition("from"))
    strict = linked.where("strength = 'STRICT'").select("from", "to", "source")
    shut = cut(protected.join(nodes, "state_id").select(F.col("version").alias("to")).distinct())
    # who else may support a protected version: its CURRENT strict sources
    support = cut(strict.join(shut, "to").join(nodes.where("status = 'CURRENT'").select(F.col("state_id").alias("source")), "source", "left_semi").select("to", F.col("from").alias("by")).distinct())
    one = seeds.join(nodes, "state_id").select("version").distinct()
    kind = states.schema["version"].dataType
    first = cut(one.select("version", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(kind).alias("via"), F.col("version").alias("root"), F.lit(True).alias("fallen")))
    levels, front = [first], first
    for depth in count(1) if not strict.isEmpty() else ():
        reached = strict.select("from", "to").join(front.select(F.col("version").alias("from"), "root"), "from").groupBy("to").agg(F.min("from").alias("via"), F.min("root").alias("root"))
        for level in levels:
            reached = reached.join(level.select(F.col("version").alias("to")), "to", "left_anti")
        fresh = cut(reached)
        if fresh.isEmpty():
            break
        stands = support
        for level in [*levels, fresh.withColumnRenamed("to", "version")]:
            stands = stands.join(level.select(F.col("version").alias("by")), "by", "left_anti")
        guarded = shut.join(stands.select("to").distinct(), "to", "left_anti").withColumn("kept", F.lit(True))
        step = fresh.join(guarded, "to", "left").select(F.col("to").alias("version"), F.lit(depth).cast("long").alias("depth"), "via", "root", F.col("kept").isNull().alias("fallen"))
        step = cut(step)
        levels.append(step)
        if len(levels) > LEVELS:
            levels = [cut(reduce(DataFrame.unionByName, levels))]
        front = step.where("fallen")
    done = reduce(DataFrame.unionByName, levels)
    weak = linked.where("strength = 'WEAK'").join(done.where("fallen").select(F.col("version").alias("from"), "depth", "root"), "from")
    weak = weak.groupBy(F.col("to").alias("version")).agg((F.min("depth") + 1).alias("depth"), F.min("from").alias("via"), F.min("root").alias("root"))
    weak = weak.join(done.where("fallen").select("version"), "version", "left_anti")
    active = F.col("status").isin(ACTIVE)
    fell = F.when(~F.col("fallen"), "PROTECTED").when(~active, "PASSED").when(F.col("depth") == 0, "SEED").otherwise("STALE")
    columns = ["state_id", "version", "depth", "via", "root"]
    # a protected version may be marked for revalidation besides
    return done.join(nodes, "version").select(*columns, fell.alias("outcome")).unionByName(weak.join(nodes.where(active), "version").select(*columns, F.lit("REVALIDATE").alias("outcome")))
