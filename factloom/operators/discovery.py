"""Candidates for dependencies between states, from four sources of signals, merged to one row a directed pair.

States: group_id, state_id, entity, attribute, value, status, span, evidence_ids, observation_index, sequence_index, and
for new ones depends (selectors with a relation type). Candidates go from an available state to a new one. No source
compares all states with all: selectors and evidence meet by equality, the entities that a causal clause names meet the
clause's phrases by equality, and pairs of one text meet within buckets of sentences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import evidence, identity
from factloom.operators import selectors

ACTIVE = ["CURRENT", "UNCERTAIN"]
#: Signal of a stated relation (fixed values).
STATED = {"depends-on": "used_by_relation", "derived-from": "derived_claim_relation", "affects-action": "action_precondition"}
PAIR = ["group_id", "prerequisite", "dependent"]
#: Sentences that two states of one text may lie apart.
REACH = 2


def stated(new: DataFrame, available: DataFrame) -> DataFrame:
    """Pairs whose dependent names its prerequisite by a selector that hits no other state."""
    mine = [F.col(f).alias(f"own_{f}") for f in selectors.FIELDS]
    among = available.select(F.col("state_id").alias("own"), F.lit(True).alias("own_among")).distinct()
    s = new.select("group_id", F.col("state_id").alias("own"), *mine, F.explode("depends").alias("s"))
    s = s.select("group_id", "own", *[f"own_{f}" for f in selectors.FIELDS], *[F.col(f"s.{f}").alias(f"sel_{f}") for f in selectors.FIELDS], F.col("s.relation_type").alias("relation_type"))
    s = s.join(among, "own", "left")
    got = selectors.exactly_one(s, available.withColumn("version_id", F.col("state_id")), own="own").where("found = 'ONE'")
    kind = F.create_map(*[F.lit(x) for p in STATED.items() for x in p])
    return got.select("group_id", F.col("state_id").alias("prerequisite"), F.col("own").alias("dependent"), F.array(F.lit("explicit_semantic_relation"), kind[F.col("relation_type")]).alias("signals"), F.col("relation_type").alias("proposed"), F.lit("stated").alias("reason"))


def shared_evidence(new: DataFrame, available: DataFrame) -> DataFrame:
    """Pairs with an evidence id in common."""
    side = lambda df, name: df.select("group_id", F.col("state_id").alias(name), F.explode(F.array_distinct("evidence_ids")).alias("e"))
    both = side(available, "prerequisite").join(side(new, "dependent"), ["group_id", "e"]).where("prerequisite <> dependent")
    return both.select(*PAIR).distinct().select(*PAIR, F.array(F.lit("execution_provenance")).alias("signals"), F.lit(None).cast("string").alias("proposed"), F.lit("shared evidence").alias("reason"))


def causal_clause(span: Column) -> Column:
    """The evidence from its first causal marker on, the whole where that is "after"; null without one or without wording of a dependency."""
    tail = F.regexp_extract(span, "(?is)" + evidence.CAUSAL_CLAUSE + ".*$", 0)
    clause = F.when(F.lower(tail).startswith("after"), span).otherwise(tail)
    return F.when((tail != "") & F.lower(span).rlike(evidence.PROVENANCE), clause)


def causal_mentions(new: DataFrame, available: DataFrame) -> DataFrame:
    """Pairs whose dependent's causal clause names the prerequisite's entity as whole words.

    Entities meet the clause's runs of as many words as there are entities of that length, by equality; what is between
    the words is then compared on the pairs that are left.
    """
    who = F.lower(F.trim(F.col("entity")))
    named = available.select("group_id", F.col("state_id").alias("prerequisite"), who.alias("who"), identity.words(who).alias("w")).where("size(w) > 0")
    named = named.withColumn("n", F.size("w")).withColumn("phrase", F.array_join("w", " "))
    sizes = named.groupBy("group_id").agg(F.collect_set("n").alias("sizes"))  # lengths of names: a few numbers
    clause = new.select("group_id", F.col("state_id").alias("dependent"), "span", F.lower(causal_clause(F.col("span"))).alias("clause")).where("clause is not null").join(sizes, "group_id")
    w = identity.words(F.col("clause"))
    runs = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("cw") - n + 1)), lambda i: F.array_join(F.slice("cw", i, n), " "))))
    said = clause.withColumn("cw", w).select("group_id", "dependent", "span", "clause", F.explode(F.array_distinct(runs)).alias("phrase"))
    met = said.join(named, ["group_id", "phrase"]).where("prerequisite <> dependent")
    whole = F.concat(F.lit(r"(?<!\w)\Q"), F.regexp_replace("who", r"\\E", ""), F.lit(r"\E(?!\w)"))
    met = met.where(F.regexp_like("clause", whole))
    signals = F.array(F.lit("explicit_source_relation"), F.lit("causal_text_grounding"))
    return met.select(*PAIR, signals.alias("signals"), F.lit(None).cast("string").alias("proposed"), F.col("span").alias("reason")).distinct()


def nearby(new: DataFrame, available: DataFrame, reach: int = REACH) -> DataFrame:
    """Ordered pairs of one text at most ``reach`` sentences apart: group_id, text_id, prerequisite, dependent, window_start, window_end.

    States located in a text: group_id, text_id, state_id, sentence, sentence_start, sentence_end. Prerequisites go to the
    buckets of ``reach`` + 1 sentences around theirs, dependents to their own, so a pair meets in exactly one bucket.
    """
    size = reach + 1
    bucket = F.floor(F.col("sentence") / size)
    p = available.select("group_id", "text_id", F.col("state_id").alias("prerequisite"), F.col("sentence").alias("p"), F.col("sentence_start").alias("p0"), F.col("sentence_end").alias("p1"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    d = new.select("group_id", "text_id", F.col("state_id").alias("dependent"), F.col("sentence").alias("d"), F.col("sentence_start").alias("d0"), F.col("sentence_end").alias("d1"), bucket.alias("bucket"))
    both = p.join(d, ["group_id", "text_id", "bucket"]).where((F.abs(F.col("p") - F.col("d")) <= reach) & (F.col("prerequisite") != F.col("dependent")))
    return both.select("group_id", "text_id", "prerequisite", "dependent", F.least("p0", "d0").alias("window_start"), F.greatest("p1", "d1").alias("window_end"))


def candidates(new: DataFrame, available: DataFrame) -> DataFrame:
    """group_id, prerequisite, dependent, signals, proposed, reason: one row a directed pair.

    ``available`` are the active states and those that this transaction made stale; ``new`` must be active. A stated
    relation's type and reason come first, then a causal clause, then shared evidence.
    """
    new = new.where(F.col("status").isin(ACTIVE))
    parts = [stated(new, available), causal_mentions(new, available), shared_evidence(new, available)]
    every = reduce(DataFrame.unionByName, [p.withColumn("_order", F.lit(i)) for i, p in enumerate(parts)])
    first = F.min(F.struct("_order", "reason"))["reason"]
    signals = F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals"))))
    # several selectors of a dependent may name one prerequisite
    return every.groupBy(*PAIR).agg(signals.alias("signals"), F.min("proposed").alias("proposed"), first.alias("reason"))
