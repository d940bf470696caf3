"""Which verified dependencies may be kept: evidence must name both ends in the right order around a causal marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import evidence, identity
from factloom.operators import dependency
from factloom.operators.ingest import with_relation_ids
from factloom.operators.linking import roots
from factloom.sources.durable import cut
from factloom.sources.store import Store

#: Fixed values of the direction rules: markers by what they say of the ends, and words that name no end.
BECAUSE = r"\b(?:because|due\s+to|as\s+a\s+result\s+of|as\s+a\s+consequence\s+of)\b"
TARGET_REQUIRES_SOURCE = r"\b(?:requires?|depends?\s+on|relies?\s+on|only\s+(?:if|when|while)|provided\s+that|unless|without|derived\s+from|computed\s+from|calculated\s+from|inferred\s+from|based\s+on)\b"
SOURCE_AFFECTS_TARGET = r"\b(?:causes?|leads?\s+to|enables?|may\s+affect|might\s+affect|could\s+affect|affects?|results?\s+in|is\s+required\s+for|are\s+required\s+for|is\s+necessary\s+for|is\s+needed\s+for|is\s+a\s+prerequisite\s+for|therefore|consequently|as\s+a\s+result|so\s+that)\b"
NO_ANCHOR = [*dependency.STOPWORDS, *"state thing item status true false null".split()]
RELATIONS = ["depends-on", "derived-from", "affects-action"]
STRENGTHS = ["STRICT", "WEAK"]
#: letters and digits, no underscores
TOKENS = r"[\p{L}\p{M}\p{N}]+"

PLAN, DERIVED, UNKNOWN = "ACTION_OR_PLAN", "DERIVED_STATE", "UNKNOWN"


def _forms(tokens: Column) -> Column:
    """The tokens, those in -ability also in -able and the other way round."""
    able = F.transform(F.filter(tokens, lambda t: t.endswith("ability") & (F.length(t) > 8)), lambda t: F.regexp_replace(t, "ability$", "able"))
    ability = F.transform(F.filter(tokens, lambda t: t.endswith("able") & (F.length(t) > 5)), lambda t: F.regexp_replace(t, "able$", "ability"))
    return F.array_distinct(F.concat(tokens, able, ability))


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKENS), F.lit(0))


def anchors(*texts: Column) -> Column:
    """Words (two letters and more) by which evidence may name a state, in all their forms."""
    words = F.filter(F.array_distinct(_tokens(F.concat_ws(" ", *texts))), lambda w: F.length(w) > 1)
    return _forms(F.array_except(words, identity.literal_set(NO_ANCHOR)))


def _parts(span: Column, marker: str) -> Column:
    """The span's words in parts: between markers (even places) and within them (odd places)."""
    pattern = "(?iU)" + marker
    between, marks = F.split(span, pattern), F.regexp_extract_all(span, F.lit(pattern), F.lit(0))
    return F.transform(F.flatten(F.transform(between, lambda t, i: F.array(t, F.get(marks, i)))), _tokens)


def _split_at(parts: Column, test) -> Column:
    """Whether ``test(words before, words after)`` holds at any marker."""
    n = F.floor(F.size(parts) / 2).cast("int")  # one more than there are markers
    places = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: test(F.flatten(F.slice(parts, 1, 2 * i - 1)), F.flatten(F.slice(parts, 2 * i + 1, F.size(parts)))))


def supported(span: Column, source: Column, target: Column) -> Column:
    """The span names both ends, each by words of its own, in the order that one of its markers asks for.

    source, target: arrays of ``anchors``. Words that both have name neither, unless an end has no others. "target because source",
    "because source ... target", "target requires source", "source affects target".
    """
    both = F.array_intersect(source, target)
    own = lambda a: F.when(F.size(F.array_except(a, both)) > 0, F.array_except(a, both)).otherwise(a)
    s, t = own(source), own(target)
    said = lambda words, names: F.arrays_overlap(_forms(words), names)

    def because(before, after):
        # the first word of the source, and a word of the target behind it
        at = lambda w: F.arrays_overlap(_forms(F.array(w)), s)
        first = F.array_min(F.filter(F.transform(after, lambda w, i: F.when(at(w), i)), lambda i: i.isNotNull()))
        behind = F.coalesce(F.slice(after, first + 2, F.size(after) + 1), F.array().cast("array<string>"))
        return (said(before, t) & said(after, s)) | said(behind, t)

    needs = lambda before, after: said(before, t) & said(after, s)
    acts = lambda before, after: said(before, s) & said(after, t)
    text = F.coalesce(span, F.lit(""))
    return _split_at(_parts(text, BECAUSE), because) | _split_at(_parts(text, TARGET_REQUIRES_SOURCE), needs) | _split_at(_parts(text, SOURCE_AFFECTS_TARGET), acts)


def _ends(relations: DataFrame, states: DataFrame) -> DataFrame:
    """relations with the states at both ends as structs s and t (aliases followed; null where there is none)."""
    key = lambda c: F.concat_ws("\x1f", "group_id", c)
    known = states.dropDuplicates(["group_id", "state_id"])
    up = roots(known.where("duplicate_of is not null").select(key("state_id").alias("state"), key("duplicate_of").alias("parent"))).select("state", "root")
    node = F.struct("state_id", "status", "observed_at", evidence.role(F.col("entity"), F.col("attribute"), F.col("value")).alias("role"), anchors(F.col("entity"), F.col("attribute"), F.col("value").cast("string")).alias("names"))
    at = cut(known.select(key("state_id").alias("root"), node.alias("node")))
    for end, name in (("source", "s"), ("target", "t")):
        through = relations.withColumn("state", key(end)).join(up.withColumn("aliased", F.lit(True)), "state", "left")
        through = through.withColumn("root", F.when(F.col("aliased"), F.col("root")).otherwise(F.col("state"))).drop("state", "aliased")
        relations = through.join(at.withColumnRenamed("node", name), "root", "left").drop("root")
    return relations


def guarded(relations: DataFrame, states: DataFrame) -> DataFrame:
    """relations with source and target as the states that their aliases stand for, source_role, target_role and reason (null: accepted).

    relations: group_id, source, target, relation_type, strength, spans (array: the evidence), counterfactual,
    direction_supported, evidence_supported, source_grounded, target_grounded (booleans of the verifier), and others that
    pass through. states: group_id, state_id, entity, attribute, value, status, observed_at, duplicate_of (the state
    that this is an alias of, else null). Rejected, first reason first: an end that isn't there or whose aliases go round; a type or
    strength that is no verified dependency's; evidence that supports no direction; a plan or derived state as the
    premise of a fact or decision; a plan that is over as the premise of a later state that is active; a verdict that is
    missing, STRICT without or WEAK with counterfactual support; an end without meaning. Null spans are none; repeated
    rows stay.
    """
    r = _ends(relations, states)
    s, t = F.col("s"), F.col("t")
    spans = F.filter(F.coalesce("spans", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    led = F.exists(spans, lambda x: supported(x, F.col("s.names"), F.col("t.names")))
    backwards = s["role"].isin(PLAN, DERIVED) & t["role"].isin("ORDINARY_FACT", "DECISION", UNKNOWN)
    over = s["status"].isin("STALE", "HISTORICAL") & t["status"].isin(dependency.ACTIVE) & (s["observed_at"] <= t["observed_at"]) & (s["role"] == PLAN)
    meant = dependency.semantics_valid(F.col("strength"), F.col("counterfactual"), *[F.col(c) for c in ("direction_supported", "evidence_supported", "source_grounded", "target_grounded")])
    no = lambda c: F.coalesce(~c, F.lit(True))
    reason = (
        F.when(s.isNull() | t.isNull(), "unknown end")
        .when(no(F.col("relation_type").isin(RELATIONS)), "no dependency")
        .when(no(F.col("strength").isin(STRENGTHS)), "not verified")
        .when(~led, "evidence supports no direction")
        .when(backwards, "backwards")
        .when(F.coalesce(over, F.lit(False)), "over")
        .when(~meant, "verdict incomplete")
        .when((s["role"] == UNKNOWN) | (t["role"] == UNKNOWN), "end without meaning")
    )
    rest = [c for c in relations.columns if c not in ("source", "target")]
    return r.select(*rest, F.coalesce("s.state_id", "source").alias("source"), F.coalesce("t.state_id", "target").alias("target"), F.col("s.role").alias("source_role"), F.col("t.role").alias("target_role"), reason.alias("reason"))


def accepted(judged: DataFrame) -> DataFrame:
    """One relation for group, ends and type of what ``guarded`` accepted: STRICT before WEAK, then the earliest, then the least evidence; ids as the ingest makes them.

    judged also has evidence_id and created_at. The rows are those of the store's relations.
    """
    w = W.partitionBy("group_id", "source", "target", "relation_type").orderBy("strength", "created_at", "evidence_id")
    one = judged.where("reason is null").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return with_relation_ids(one.select("group_id", "source", "target", "relation_type", "strength", F.lit("verified").alias("reason"), "evidence_id", "created_at"))


def persist(store: Store, relations: DataFrame, key: str) -> DataFrame:
    """Commits the accepted ones of ``relations`` (all or nothing; the same key again changes nothing) and returns the verdict on each."""
    groups = relations.select("group_id").distinct()
    judged = cut(guarded(relations, store.states(groups)))
    store.commit({"relations": accepted(judged)}, key)
    return judged
