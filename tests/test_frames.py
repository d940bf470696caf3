"""Typed frames: identities by cases, and changes against a plain list of frames that is searched for each change."""

import datetime as dt
import random

from factloom.operators import frames

PAIR = "array<struct<key:string,value:string>>"
SCHEMA = f"group_id string, candidate_id long, kind string, subject string, predicate string, facet string, value string, bindings {PAIR}, participants array<struct<role:string,surface:string>>, t0 timestamp_ntz, t1 timestamp_ntz, cond {PAIR}, polarity string, modality string, confidence double, operation string, hint string, changed array<string>, sequence long, authorised boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
RULES = [("FACT", "likes", None, "SET_VALUED", []), ("FACT", "lives in", None, "FUNCTIONAL", []), ("RELATION", "owns", "share", "MULTI_EVENT", ["asset"])]


def row(i, kind="FACT", predicate="lives in", value="Rome", **more):
    base = dict.fromkeys(NAMES)
    base |= {"group_id": "g", "candidate_id": i, "kind": kind, "subject": "Ann", "predicate": predicate, "value": value, "polarity": "POSITIVE", "modality": "ASSERTED", "confidence": 0.9, "operation": "ASSERT", "sequence": i, "authorised": True}
    return tuple({**base, **more}[n] for n in NAMES)


def registry(spark):
    return spark.createDataFrame(RULES, "kind string, predicate string, facet string, cardinality string, keys array<string>")


def test_identity(spark):
    rows = [
        row(1), row(2, subject="  ANN ", predicate="Lives  in", value="Oslo"), row(3, t0=dt.datetime(2024, 1, 1)), row(4, predicate="knows"),
        row(5, predicate="likes", value="C"), row(6, predicate="likes", value="C++"), row(7, bindings=[("x", "y")]),
        row(8, "EVENT", "gala", facet="time"), row(9, "EVENT", "gala", facet="Time", bindings=[("Instance", "5")]), row(10, "EVENT", "gala", facet="location", bindings=[("instance", "5")]),
        row(11, "ROLE", "works", facet="role", bindings=[("organization", "ACME")], value="clerk"), row(12, "ROLE", "works", facet="role", bindings=[("organization", "acme")], value="boss"),
        row(13, "ROLE", "works", facet="role"), row(14, "ROLE", "works", facet="role", bindings=[("organization", "acme")], participants=[("organization", "Other")]),
        row(15, "RELATION", "owns", facet="share", bindings=[("asset", "boat")]), row(16, "RELATION", "owns", facet="share"), row(17, None, None, None, subject=None),
    ]
    got = {r.candidate_id: r for r in frames.identified(spark.createDataFrame(rows, SCHEMA), registry(spark)).collect()}
    assert len(got) == len(rows)
    one, many = "FUNCTIONAL", "SET_VALUED"
    assert {i: (r.cardinality, r.issue) for i, r in got.items()} == {
        1: (one, None), 2: (one, None), 3: (one, None), 4: (None, "UNKNOWN_CARDINALITY"), 5: (many, None), 6: (many, None), 7: (one, "MISSING_OR_UNRECOGNIZED_IDENTITY_BINDINGS"),
        8: (None, "MISSING_INSTANCE_DISCRIMINATOR"), 9: ("SINGLE_EVENT_INSTANCE", None), 10: ("SINGLE_EVENT_INSTANCE", None), 11: (many, None), 12: (many, None),
        13: (None, "MISSING_ROLE_ORGANIZATION"), 14: (many, "PARTICIPANT_BINDING_MISMATCH"), 15: ("MULTI_EVENT", None), 16: ("MULTI_EVENT", "MISSING_OR_UNRECOGNIZED_IDENTITY_BINDINGS"), 17: (None, "UNKNOWN_CARDINALITY"),
    }
    same = lambda x, a, b: getattr(got[a], x) == getattr(got[b], x)
    assert same("slot_id", 1, 2) and same("frame_id", 1, 3) and not same("slot_id", 1, 3) and not same("frame_id", 5, 6)
    assert same("frame_id", 9, 10) and not same("slot_id", 9, 10) and same("slot_id", 11, 12) and not same("frame_id", 12, 14)


def plain(rows):
    """Every change against the list of all frames there are; a frame is (row, life)."""
    store, out = [], {}
    for c in sorted(rows, key=lambda r: (r["sequence"], r["candidate_id"])):
        slot = [f for f in store if f[0]["slot_id"] == c["slot_id"]]
        live = [f for f in slot if f[1] in ("CURRENT", "UNCERTAIN")]
        fact = c["cardinality"] == "SET_VALUED" and c["kind"] in ("FACT", "RELATION")
        scoped, operation = bool(c["t0"] or c["t1"] or c["cond"]), {"UNKNOWN": "ASSERT"}.get(c["operation"], c["operation"])
        old = live[0][0] if live else None
        if fact and c["operation"] == "ASSERT" and old and old["polarity"] == "POSITIVE" and c["polarity"] == "NEGATED":
            operation = "REMOVE"
        withdraw = operation == "REMOVE" and c["kind"] == "ROLE" and c["facet"] == "status"
        hit = [f for f in store if f[0]["frame_id"] == c["frame_id"] and f[0]["scope_id"] == c["scope_id"] and f[1] in ("CURRENT", "UNCERTAIN")] if withdraw else live
        rules = [
            (c["issue"] is not None, "UNCERTAIN", c["issue"]),
            (c["confidence"] < 0.5 or c["polarity"] == "UNKNOWN", "UNCERTAIN", "LOW_CONFIDENCE_OR_UNKNOWN_POLARITY"),
            (len(live) > 1 or any(f[1] == "UNCERTAIN" for f in live), "UNCERTAIN", "AMBIGUOUS_IDENTITY"),
            (old and operation != "REMOVE" and (old["value"], old["polarity"], old["modality"]) == (c["value"], c["polarity"], c["modality"]), "MERGE", "SAME_VALUE"),
            (operation == "ASSERT" and old, "UNCERTAIN", "ASSERT_DOES_NOT_AUTHORIZE_REPLACEMENT"),
            (operation == "ASSERT", "CREATE", "NEW_ASSERTION"),
            (operation == "ADD" and c["cardinality"] not in ("SET_VALUED", "MULTI_EVENT"), "UNCERTAIN", "ADD_TO_FUNCTIONAL_SLOT"),
            (operation == "ADD" and old, "UNCERTAIN", "ADD_CONFLICTS_WITH_EXISTING_MEMBER"),
            (operation == "ADD", "ADD", "NEW_MEMBER"),
            (fact and operation == "REMOVE" and not (old and old["polarity"] == "POSITIVE" and c["value"] is not None), "UNCERTAIN", "REMOVE_REQUIRES_POSITIVE_MEMBER_TARGET"),
            (fact and operation == "REMOVE" and (scoped or c["modality"] not in (None, "ASSERTED", "PREFERRED")), "UNCERTAIN", "MEMBER_REMOVAL_SCOPE_UNCONFIRMED"),
            (operation == "REPLACE" and not slot and c["cardinality"] in ("FUNCTIONAL", "SINGLE_EVENT_INSTANCE") and c["hint"] is None and c["polarity"] == "POSITIVE" and c["authorised"], "CREATE", "FIRST_KNOWN_POSTCONDITION"),
            (not hit or any(f[1] != "CURRENT" for f in hit), "UNCERTAIN", "MISSING_OR_AMBIGUOUS_DESTRUCTIVE_TARGET"),
            (any(c["sequence"] <= f[0]["sequence"] for f in hit), "UNCERTAIN", "NON_FORWARD_OBSERVATION_ORDER"),
            (c["hint"] is not None and any(f[0]["value"] != c["hint"] for f in hit), "UNCERTAIN", "TARGET_VALUE_HINT_MISMATCH"),
            (operation == "PATCH" and not (c["facet"] and c["changed"] == [c["facet"]]), "UNCERTAIN", "PATCH_MUST_NAME_EXACTLY_ONE_FACET"),
            (not c["authorised"], "UNCERTAIN", "UNSUPPORTED_DESTRUCTIVE_HINT"),
            (operation == "REMOVE" and c["cardinality"] not in ("SET_VALUED", "MULTI_EVENT"), "UNCERTAIN", "REMOVE_REQUIRES_MEMBER_SLOT"),
            (operation == "REMOVE", "REMOVE", "GROUNDED_MEMBER_REMOVAL"),
            (True, operation, "GROUNDED_FORWARD_CHANGE"),
        ]
        _, status, reason = next(r for r in rules if r[0])
        ended = hit if status in ("REPLACE", "PATCH", "REMOVE") else []
        for f in ended:
            f[1] = "STALE"
        out[c["candidate_id"]] = (status, reason, ",".join(sorted(str(f[0]["candidate_id"]) for f in ended)))
        if status != "MERGE":
            store.append([{**c, "polarity": "NEGATED"} if status == "REMOVE" else c, "UNCERTAIN" if status == "UNCERTAIN" else "CURRENT"])
    return out


def test_changes(spark):
    r = random.Random(11)
    rows = []
    for i in range(6000):
        kind = r.choice(["FACT", "FACT", "FACT", "ROLE", "ROLE", "EVENT"])
        facet = {"FACT": None, "ROLE": r.choice(["role", "status", "status"]), "EVENT": r.choice(["time", "location"])}[kind]
        predicate = {"FACT": r.choice(["likes", "lives in"]), "ROLE": "works", "EVENT": "gala"}[kind]
        rare = lambda x, y, p=0.04: x if r.random() < p else y
        rows.append(row(
            i, kind, predicate, r.choice(["Rome", "Oslo"]), facet=facet, subject=f"s{r.randint(0, 500)}", bindings={"FACT": None, "ROLE": [("organization", "acme")], "EVENT": [("instance", "1")]}[kind],
            t1=rare(dt.datetime(2025, 1, 1), None), polarity=rare("UNKNOWN", rare("NEGATED", "POSITIVE", 0.3), 0.02), modality=rare("PLANNED", r.choice([None, "ASSERTED"]), 0.1), confidence=rare(0.2, 0.8, 0.02),
            operation=r.choice(["ASSERT", "REPLACE", "REPLACE", "ADD", "REMOVE", "REMOVE", "PATCH", "PATCH", "UNKNOWN"]), hint=rare("Rome", None, 0.1), changed=r.choice([[facet] if facet else [], ["other"]]) if rare(1, 0, 0.5) else [facet or "x"],
            sequence=rare(max(0, i - 5000), i, 0.1), authorised=rare(False, True, 0.1),
        ))
    f = frames.identified(spark.createDataFrame(rows, SCHEMA), registry(spark)).cache()
    got = {x.candidate_id: (x.status, x.reason, x.stale) for x in frames.resolved(f).collect()}
    want = plain([x.asDict(recursive=True) for x in f.collect()])
    reasons = {x[1] for x in want.values()}
    assert {"GROUNDED_MEMBER_REMOVAL", "GROUNDED_FORWARD_CHANGE", "FIRST_KNOWN_POSTCONDITION", "TARGET_VALUE_HINT_MISMATCH", "SAME_VALUE", "REMOVE_REQUIRES_MEMBER_SLOT", "MEMBER_REMOVAL_SCOPE_UNCONFIRMED"} <= reasons
    assert any("," in x[2] for x in want.values())
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_empty_and_nulls(spark):
    assert frames.resolved(frames.identified(spark.createDataFrame([], SCHEMA))).count() == 0
    bare = row(1, operation=None, polarity=None, confidence=None, authorised=None)
    got = frames.resolved(frames.identified(spark.createDataFrame([bare], SCHEMA), registry(spark))).collect()
    assert [(x.status, x.reason) for x in got] == [("UNCERTAIN", "LOW_CONFIDENCE_OR_UNKNOWN_POLARITY")]
