"""Typed frames: what a proposed change is about (kind, bindings, cardinality), and what may become of it.

``identified`` works out frames and slots with joins and expressions; ``resolved`` folds each frame's changes in order, a
frame with the slots of all its facets and scopes in memory at a time (one row a slot, not its history).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import identity
from factloom.operators.writer import fold

#: Facets that a kind has without a rule of its own, their cardinality and the binding that identifies them.
STRUCTURAL = [
    ("EVENT", "time location status", "SINGLE_EVENT_INSTANCE", "instance"),
    ("ROLE", "role status", "SET_VALUED", "organization"),
    ("ACTION", "status", "FUNCTIONAL", "instance"),
]
MEMBERS = ["SET_VALUED", "MULTI_EVENT"]
ONE_VALUE = ["FUNCTIONAL", "SINGLE_EVENT_INSTANCE"]
CHANGES = ["REPLACE", "PATCH", "REMOVE"]
#: How a member that is taken out may have been said.
PLAIN = [None, "ASSERTED", "PREFERRED"]
LEAST_CONFIDENCE = 0.5
PAIRS = "array<struct<key:string,value:string>>"


def _pairs(c: str):
    """Bindings or conditions in normal form, in order of their keys; null is none."""
    return F.array_sort(F.transform(F.coalesce(F.col(c).cast(PAIRS), F.array().cast(PAIRS)), lambda p: F.struct(identity.norm(p["key"]).alias("key"), identity.norm(p["value"]).alias("value"))))


def identified(candidates: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """candidates with cardinality, frame_id, slot_id, scope_id and issue (null: their identity is sure).

    candidates: group_id, candidate_id (unique), kind, subject, predicate, facet, value, bindings (key, value), participants (role, surface),
    t0, t1, cond (key, value), and others that pass through. registry (a rule each): kind, predicate, facet (null: none), cardinality, keys
    (array); a rule of its own comes before the structural one of kind and facet. A frame is a group's kind, subject,
    predicate and bindings, and the value too where facts have many (a role's member is its organization, not its title);
    a slot is a facet of it in one scope. A candidate whose identity is in doubt is a frame of its own. Texts are compared
    in lower case, runs of white space as one; punctuation counts. Two rules of one key are an error.
    """
    norm = lambda c: identity.norm(F.col(c))
    c = candidates.select("*", norm("subject").alias("_s"), norm("predicate").alias("_p"), norm("facet").alias("_f"), _pairs("bindings").alias("_b"))
    keys = F.transform("_b", lambda b: b["key"])
    if registry is not None:
        many = F.raise_error(F.concat_ws(" ", F.lit("two rules:"), "kind", "_p", "_f"))
        rules = registry.groupBy("kind", norm("predicate").alias("_p"), F.coalesce(norm("facet"), F.lit("")).alias("_f")).agg(F.count("*").alias("_n"), F.first("cardinality").alias("_rule"), F.first("keys").alias("_keys"))
        rules = rules.select("kind", "_p", F.col("_f").alias("_facet"), F.when(F.col("_n") > 1, many).otherwise(F.col("_rule")).alias("_rule"), F.coalesce("_keys", F.array().cast("array<string>")).alias("_keys"))
        c = c.withColumn("_facet", F.coalesce("_f", F.lit(""))).join(rules, ["kind", "_p", "_facet"], "left").drop("_facet")
    else:
        c = c.select("*", F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("array<string>").alias("_keys"))
    own = F.lit(None).cast("string")
    for kind, facets, cardinality, key in STRUCTURAL:
        own = F.when((F.col("kind") == kind) & F.col("_f").isin(facets.split()) & (keys == F.array(F.lit(key))), cardinality).otherwise(own)
    ruled = F.col("_rule").isNotNull()
    c = c.withColumn("cardinality", F.coalesce("_rule", own))
    wanted = F.when(ruled, F.col("_keys")).otherwise(keys)
    bound = F.map_from_entries("_b")
    without = lambda key: F.coalesce(F.get(F.filter("_b", lambda b: b["key"] == key), F.lit(0))["value"], F.lit("")) == ""
    said = F.transform(F.coalesce(F.col("participants").cast("array<struct<role:string,surface:string>>"), F.array().cast("array<struct<role:string,surface:string>>")), lambda p: F.struct(identity.norm(p["role"]).alias("role"), identity.norm(p["surface"]).alias("who")))
    other = F.exists(said, lambda p: F.coalesce(F.exists("_b", lambda b: (b["key"] == p["role"]) & (b["value"] != p["who"])), F.lit(False)))
    issue = (
        F.when(other, "PARTICIPANT_BINDING_MISMATCH")
        .when((F.col("kind") == "ROLE") & without("organization"), "MISSING_ROLE_ORGANIZATION")
        .when(F.col("kind").isin("EVENT", "ACTION") & without("instance"), "MISSING_INSTANCE_DISCRIMINATOR")
        .when(F.array_sort(F.array_distinct(wanted)) != keys, "MISSING_OR_UNRECOGNIZED_IDENTITY_BINDINGS")
        .when(F.col("cardinality").isNull(), "UNKNOWN_CARDINALITY")
    )
    c = c.withColumn("issue", issue)
    member = F.when((F.col("cardinality") == "SET_VALUED") & ~F.col("kind").eqNullSafe("ROLE"), identity.norm(F.col("value")))
    frame = identity.digest("frame", identity.canonical_json(group=F.col("group_id"), kind=F.col("kind"), subject=F.col("_s"), predicate=F.col("_p"), bindings=bound, member=member, alone=F.when(F.col("issue").isNotNull(), F.col("candidate_id").cast("string"))))
    scope = identity.digest("scope", identity.canonical_json(start=F.col("t0"), end=F.col("t1"), conditions=_pairs("cond")))
    c = c.select("*", frame.alias("frame_id"), scope.alias("scope_id"))
    slot = identity.digest("slot", F.concat_ws("\x1f", "frame_id", F.coalesce("_f", "_p"), "scope_id"))
    return c.select(*candidates.columns, "cardinality", "frame_id", slot.alias("slot_id"), "scope_id", "issue")


def step(slots: dict, row: dict) -> tuple:
    """(status, reason, stale) of one change; ``slots``: of the row's frame, what is current, whether it is in doubt, its scope."""
    mine = slots.setdefault(row["slot_id"], {"current": None, "unsure": False, "ever": False, "scope": row["scope_id"]})
    now, said = mine["current"], row["operation"]

    def doubt(reason):
        mine["unsure"] = mine["ever"] = True
        return "UNCERTAIN", reason, ""

    def put(status, reason, stale=(), polarity=None):
        for s in stale:
            s["current"] = None
        gone = ",".join(sorted(str(x) for x in ends)) if stale else ""
        mine["current"], mine["ever"] = {**row, "polarity": polarity or row["polarity"]}, True
        return status, reason, gone

    ends = []
    if row["issue"]:
        return doubt(row["issue"])
    if row["confidence"] < LEAST_CONFIDENCE or row["polarity"] == "UNKNOWN":
        return doubt("LOW_CONFIDENCE_OR_UNKNOWN_POLARITY")
    if mine["unsure"]:
        return doubt("AMBIGUOUS_IDENTITY")
    member = row["cardinality"] == "SET_VALUED" and row["kind"] in ("FACT", "RELATION")
    operation = "ASSERT" if said == "UNKNOWN" else said
    if member and said == "ASSERT" and now and (now["polarity"], row["polarity"]) == ("POSITIVE", "NEGATED"):
        operation = "REMOVE"
    if now and operation != "REMOVE" and all(now[x] == row[x] for x in ("value", "polarity", "modality")):
        return "MERGE", "SAME_VALUE", ""
    if operation == "ASSERT":
        return doubt("ASSERT_DOES_NOT_AUTHORIZE_REPLACEMENT") if now else put("CREATE", "NEW_ASSERTION")
    if operation == "ADD":
        if row["cardinality"] not in MEMBERS:
            return doubt("ADD_TO_FUNCTIONAL_SLOT")
        return doubt("ADD_CONFLICTS_WITH_EXISTING_MEMBER") if now else put("ADD", "NEW_MEMBER")
    if operation not in CHANGES:
        return doubt("UNKNOWN_OPERATION")
    if member and operation == "REMOVE":
        if not now or now["polarity"] != "POSITIVE" or row["value"] is None:
            return doubt("REMOVE_REQUIRES_POSITIVE_MEMBER_TARGET")
        if row["scoped"] or row["modality"] not in PLAIN:
            return doubt("MEMBER_REMOVAL_SCOPE_UNCONFIRMED")
    first = operation == "REPLACE" and not mine["ever"] and row["cardinality"] in ONE_VALUE
    if first and row["hint"] is None and row["polarity"] == "POSITIVE" and row["authorised"]:
        return put("CREATE", "FIRST_KNOWN_POSTCONDITION")
    # a membership's end takes all facets of it in that scope along
    whole = operation == "REMOVE" and row["kind"] == "ROLE" and row["facet"] == "status"
    targets = [s for s in slots.values() if s["scope"] == row["scope_id"] and (s["current"] or s["unsure"])] if whole else [mine] if now else []
    if not targets or any(s["unsure"] for s in targets):
        return doubt("MISSING_OR_AMBIGUOUS_DESTRUCTIVE_TARGET")
    olds = [s["current"] for s in targets]
    if any(row["sequence"] <= old["sequence"] for old in olds):
        return doubt("NON_FORWARD_OBSERVATION_ORDER")
    if row["hint"] is not None and any(old["value"] != row["hint"] for old in olds):
        return doubt("TARGET_VALUE_HINT_MISMATCH")
    if operation == "PATCH" and (not row["facet"] or row["changed"] != [row["facet"]]):
        return doubt("PATCH_MUST_NAME_EXACTLY_ONE_FACET")
    if not row["authorised"]:
        return doubt("UNSUPPORTED_DESTRUCTIVE_HINT")
    if operation == "REMOVE" and row["cardinality"] not in MEMBERS:
        return doubt("REMOVE_REQUIRES_MEMBER_SLOT")
    ends = [old["candidate_id"] for old in olds]
    if operation == "REMOVE":
        return put("REMOVE", "GROUNDED_MEMBER_REMOVAL", targets, "NEGATED")
    return put(operation, "GROUNDED_FORWARD_CHANGE", targets)


def resolved(frames: DataFrame) -> DataFrame:
    """candidate_id, frame_id, slot_id, status, reason, stale (candidate ids it ends, joined by commas).

    frames: as of ``identified``, with polarity (POSITIVE, NEGATED, UNKNOWN), modality, confidence, operation (ASSERT, REPLACE, ADD, REMOVE,
    PATCH, UNKNOWN), hint (the value it says it changes; null: none said), changed (array: the facets it says it changes), sequence
    and authorised (whether evidence backs the change), in order of sequence, then candidate_id. Null confidence is 0,
    null polarity UNKNOWN, null operation ASSERT, null authorised false. CREATE, ADD, MERGE, REPLACE, PATCH and REMOVE are done;
    UNCERTAIN ones are kept beside and leave their slot in doubt.
    """
    scoped = F.col("t0").isNotNull() | F.col("t1").isNotNull() | (F.size(F.coalesce(F.col("cond").cast(PAIRS), F.array().cast(PAIRS))) > 0)
    rows = frames.select(
        "frame_id", "slot_id", "scope_id", "candidate_id", "issue", "cardinality", "kind", identity.norm(F.col("facet")).alias("facet"), F.col("value").cast("string").alias("value"), scoped.alias("scoped"),
        F.coalesce("polarity", F.lit("UNKNOWN")).alias("polarity"), "modality", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("operation", F.lit("ASSERT")).alias("operation"), F.col("hint").cast("string").alias("hint"),
        F.transform(F.coalesce("changed", F.array().cast("array<string>")), identity.norm).alias("changed"), "sequence", F.coalesce("authorised", F.lit(False)).alias("authorised"),
    )
    done = fold(rows, ["frame_id"], ["sequence", "candidate_id"], dict, step, "status string, reason string, stale string")
    return done.select("candidate_id", "frame_id", "slot_id", "status", "reason", "stale")
