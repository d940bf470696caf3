"""Version runs, conflict classification and revision of state slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SLOT = ["entity", "attribute"]
ORDER = ["observed_at", "evidence_id"]


def version_runs(states: DataFrame) -> DataFrame:
    """One row for each run of equal values of a slot: equal neighbours merge their evidence, a different value opens a version."""
    w = W.partitionBy(*SLOT).orderBy(*ORDER)
    flagged = states.withColumn("opens", F.coalesce((F.col("value") != F.lag("value").over(w)).cast("long"), F.lit(1)))
    run = flagged.withColumn("version", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*SLOT, "version").agg(F.min("value").alias("value"), F.count("*").alias("n_evidence"), F.min("observed_at").alias("valid_from"), F.max("observed_at").alias("last_seen"), F.min(F.struct("observed_at", "evidence_id"))["evidence_id"].alias("first_evidence"))


def slot_versions(states: DataFrame) -> DataFrame:
    """Versions with status CURRENT or STALE, the end of validity and the version that superseded them."""
    w = W.partitionBy(*SLOT).orderBy("version")
    v = version_runs(states).withColumn("superseded_by", F.lead("version").over(w)).withColumn("valid_to", F.lead("valid_from").over(w))
    return v.withColumn("status", F.when(F.col("superseded_by").isNull(), "CURRENT").otherwise("STALE"))


def update_edges(states: DataFrame) -> DataFrame:
    """Typed `updates` edges from the new version to the one it replaced."""
    return slot_versions(states).where("superseded_by is not null").select(*SLOT, F.col("superseded_by").alias("source_version"), F.col("version").alias("target_version"), F.lit("updates").alias("relation_type"))


def as_of(states: DataFrame, probes: DataFrame) -> DataFrame:
    """The value in force for each (probe_id, entity, at): one shuffle by entity, a running last value, no theta join."""
    left = states.select("entity", F.col("observed_at").alias("t"), F.lit(0).alias("kind"), "value", "evidence_id", F.lit(None).cast("long").alias("probe_id"))
    right = probes.select("entity", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("long").alias("evidence_id"), "probe_id")
    w = W.partitionBy("entity").orderBy("t", "kind", "evidence_id").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("in_force", F.last("value", True).over(w)).withColumn("evidence", F.last("evidence_id", True).over(w))
    return both.where("kind = 1").select("probe_id", "entity", F.col("in_force").alias("value"), F.col("evidence").alias("evidence_id"))


def late_data(states: DataFrame) -> DataFrame:
    """Arrival order is evidence_id: what is older than the newest seen before it in its slot is UNCERTAIN."""
    w = W.partitionBy(*SLOT).orderBy("evidence_id").rowsBetween(W.unboundedPreceding, -1)
    seen = states.withColumn("newest", F.max("observed_at").over(w))
    return seen.select("evidence_id", *SLOT, F.when(F.col("observed_at") < F.col("newest"), "UNCERTAIN").otherwise("CURRENT").alias("status"))


def expired(states: DataFrame, at: str) -> DataFrame:
    """Bounded scopes [observed_at, observed_at + k minutes) that end by ``at`` are HISTORICAL."""
    end = F.col("observed_at") + F.make_dt_interval(mins=F.col("k").cast("int"))
    return states.select("evidence_id", *SLOT, F.when(end <= F.lit(at).cast("timestamp_ntz"), "HISTORICAL").otherwise("CURRENT").alias("status"))


def scoped(states: DataFrame, hours: int = 24) -> DataFrame:
    return states.withColumn("scope_start", F.col("observed_at")).withColumn("scope_end", F.col("observed_at") + F.make_dt_interval(hours=F.lit(hours), mins=F.col("k").cast("int")))


def interval_conflicts(states: DataFrame, hours: int = 24) -> DataFrame:
    """Pairs of one slot with different values and overlapping scopes: an equi join on slot and day.

    A scope goes to every day that it touches; a pair that shares several days counts on the first of them.
    """
    s = scoped(states, hours).withColumn("day", F.explode(F.sequence(F.to_date("scope_start"), F.to_date("scope_end"))))
    a = s.select(*SLOT, "day", F.col("evidence_id").alias("old_id"), F.col("value").alias("old_value"), F.col("scope_start").alias("a0"), F.col("scope_end").alias("a1"))
    b = s.select(*SLOT, "day", F.col("evidence_id").alias("new_id"), F.col("value").alias("new_value"), F.col("scope_start").alias("b0"), F.col("scope_end").alias("b1"))
    first = F.col("day") == F.to_date(F.greatest("a0", "b0"))
    return a.join(b, [*SLOT, "day"]).where("old_id < new_id and old_value <> new_value and a0 < b1 and b0 < a1").where(first).select(*SLOT, "old_id", "new_id")


def classify(new: DataFrame) -> DataFrame:
    """Conflict class of each observation against the one before it in its slot (first matching rule wins).

    Rules: equal value and condition DUPLICATE; equal value CONSISTENT; disjoint conditions CONSISTENT (never linked);
    narrower condition TEMPORARY_EXCEPTION; later UPDATE; else UNCERTAIN. A condition is present where k is even.
    """
    w = W.partitionBy(*SLOT).orderBy("evidence_id")
    c = F.when(F.col("k") % 2 == 0, F.col("k"))
    p = new.select("*", c.alias("c")).select("*", F.lag("value").over(w).alias("pv"), F.lag("c").over(w).alias("pc"), F.lag("observed_at").over(w).alias("pt"), F.lag("evidence_id").over(w).alias("old_id"))
    kind = (
        F.when(F.col("c").isNotNull() & F.col("pc").isNotNull() & (F.col("c") != F.col("pc")), "CONSISTENT")
        .when((F.col("value") == F.col("pv")) & F.col("c").eqNullSafe(F.col("pc")), "DUPLICATE")
        .when(F.col("value") == F.col("pv"), "CONSISTENT")
        .when(F.col("c").isNotNull() & F.col("pc").isNull(), "TEMPORARY_EXCEPTION")
        .when(F.col("observed_at") > F.col("pt"), "UPDATE")
        .otherwise("UNCERTAIN")
    )
    return p.where("old_id is not null").select("evidence_id", "old_id", *SLOT, kind.alias("conflict"))


def link_pool(states: DataFrame, limit: int = 8, margin: float = 0.5) -> DataFrame:
    """For each entity's newest observation: its pool of current versions, scored, top ``limit``, with the decisive one.

    +2 same subject, +1 equal attribute, +0.5 equal condition parity, +0.5 seen within a day.
    """
    newest = states.groupBy("entity").agg(F.max_by(F.struct("evidence_id", "attribute", "k", "observed_at"), F.struct("observed_at", "evidence_id")).alias("n"))
    w = W.partitionBy(*SLOT).orderBy(F.desc("observed_at"), F.desc("evidence_id"))
    current = states.withColumn("r", F.row_number().over(w)).where("r = 1")
    pair = current.join(newest, "entity").where(F.col("evidence_id") != F.col("n.evidence_id"))
    day = F.col("observed_at") >= F.col("n.observed_at") - F.make_dt_interval(days=F.lit(1))
    score = 2.0 + F.when(F.col("attribute") == F.col("n.attribute"), 1.0).otherwise(0.0) + F.when(F.col("k") % 2 == F.col("n.k") % 2, 0.5).otherwise(0.0) + F.when(day, 0.5).otherwise(0.0)
    rank = W.partitionBy("entity").orderBy(F.desc("score"), "target_id")
    scored = pair.select("entity", F.col("n.evidence_id").alias("new_id"), F.col("evidence_id").alias("target_id"), score.alias("score"))
    ranked = scored.withColumn("pool_rank", F.row_number().over(rank).cast("long")).withColumn("runner_up", F.lead("score").over(rank))
    decisive = (F.col("pool_rank") == 1) & (F.coalesce(F.col("score") - F.col("runner_up"), F.lit(margin)) >= margin)
    return ranked.where(F.col("pool_rank") <= limit).select("entity", "new_id", "target_id", "score", "pool_rank", decisive.alias("decisive"))
