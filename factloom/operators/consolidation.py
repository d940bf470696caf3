"""Candidates of one observation that say the same are one: blocks, components of what overlaps, one winner each, in any order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import identity, scope
from factloom.operators import graph, intervals

BLOCK = ["group_id", "observation_id", "_subject", "_field", "_value"]


def consolidated(candidates: DataFrame) -> DataFrame:
    """candidates with the merged ones gone: the winner's columns, and of all of its component's

    t0, t1 (the union of their times; an open bound absorbs others), cond (the conditions that all share), confidence
    (the greatest), evidence_ids (all, sorted) and n_merged.

    Candidates are compared within one observation, subject, field and value in normal form. Two belong together where
    their times and conditions meet, and with all that these belong together with. The winner is the one of the least
    (sequence_index, candidate_id). Candidates: group_id, observation_id, candidate_id, sequence_index, entity,
    attribute, value, t0, t1, cond, confidence, observed_at, evidence_ids; other columns are the winner's.
    """
    t0, t1 = scope.semantic_scope(F.col("t0"), F.col("t1"), F.col("observed_at"))
    c = candidates.withColumn("_subject", identity.norm(F.col("entity"))).withColumn("_field", identity.attribute_id(F.col("attribute"))).withColumn("_value", identity.state_value(F.col("attribute"), F.col("value")))
    c = c.withColumn("t0", t0).withColumn("t1", t1)
    rows = c.select(*BLOCK, F.col("candidate_id").alias("id"), "t0", "t1", "cond")
    edges = intervals.overlapping(rows, BLOCK, every=True).select(F.col("id").alias("source"), F.col("other").alias("target"))
    label = graph.components(edges)
    c = c.join(label.withColumnRenamed("node", "candidate_id"), "candidate_id", "left").withColumn("_label", F.coalesce("label", "candidate_id"))
    start, end = scope.union_scope(F.col("t0"), F.col("t1"))
    shared = F.reduce(F.collect_list("cond"), F.first("cond"), lambda a, b: F.array_intersect(a, b))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids"))))
    own = [x for x in candidates.columns if x not in ("t0", "t1", "cond", "confidence", "evidence_ids")]
    winner = F.min_by(F.struct(*own), F.struct("sequence_index", "candidate_id")).alias("_w")
    g = c.groupBy("_label").agg(winner, start.alias("t0"), end.alias("t1"), F.array_sort(shared).alias("cond"), F.max("confidence").alias("confidence"), ids.alias("evidence_ids"), F.count("*").alias("n_merged"))
    return g.select(*[F.col(f"_w.{x}").alias(x) for x in own], "t0", "t1", "cond", "confidence", "evidence_ids", "n_merged")
