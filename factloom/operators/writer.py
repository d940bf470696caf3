"""Order-dependent writes: each slot's candidates are folded in order, with one slot's state in memory at a time.

``fold`` deals rows to partitions by slot and sorts them there, so a slot streams through its task row by row; a slot
with a third of all rows costs its task time, not memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(rows: DataFrame, slot: list[str], order: list[str], start: Callable[[], object], step: Callable, fields: str) -> DataFrame:
    """rows with the columns in ``fields`` ("name type, ..."), which ``step(state, row) -> tuple`` gives for each row.

    A candidate seen again (all columns equal) directly behind itself is folded again: make that a replay in ``step``.
    """
    names = rows.columns
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), fields])
    new = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        key, state = None, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in names}
            out = []
            for i in range(batch.num_rows):
                row = {c: cols[c][i] for c in names}
                at = tuple(row[c] for c in slot)
                if at != key:
                    key, state = at, start()
                out.append(step(state, row))
            extra = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string()) for _ in new]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, *new])

    return rows.repartition(*[F.col(c) for c in slot]).sortWithinPartitions(*slot, *order).mapInArrow(run, schema)


def strict_step(state: dict, row: dict) -> tuple:
    """(outcome, target): how the strict writer treats a candidate, given what its slot holds.

    row: version, value, positive, cardinality (FUNCTIONAL, SET_VALUED, UNKNOWN), plain (asserted, unconditional, in
    effect), supported, observation, at, ended.
    """
    here = row["at"], row["version"]
    if here == state["last"]:  # rows come in this order, so a replay follows its first directly
        return "REPLAY", row["version"]
    state["last"] = here
    now = state["current"]
    same = now is not None and now["value"] == row["value"] and now["positive"] == row["positive"]
    if row["positive"] and row["plain"] and same and row["supported"]:
        return "MERGE", now["version"]
    known = row["cardinality"] != "UNKNOWN"
    outcome, target = "CREATE", None
    if now is None and row["positive"] and row["plain"]:
        pass
    elif now is not None:
        fits = row["positive"] or (now["positive"] and row["value"] == now["value"])
        later = row["observation"] != now["observation"] and row["at"] > now["at"]
        if known and row["plain"] and not same and fits and later and row["supported"]:
            outcome, target = ("REPLACE" if row["positive"] else "REMOVE"), now["version"]
        else:
            outcome = "UNCERTAIN"
    elif not (known and row["plain"] and row["supported"]):
        outcome = "UNCERTAIN"
    if target is not None:
        state["current"] = None
    if row["ended"]:
        return "HISTORICAL", target
    if outcome != "UNCERTAIN":
        state["current"] = row
    return outcome, target


def strict(rows: DataFrame) -> DataFrame:
    """Candidates (slot and the columns of ``strict_step``) with outcome and target, in order of at and version; a version is at one time."""
    return fold(rows, ["slot"], ["at", "version"], lambda: {"last": None, "current": None}, strict_step, "outcome string, target string")


def frame_step(state: dict, row: dict) -> tuple:
    """(status, reason) of a typed frame's proposed change.

    row: operation, cardinality (FUNCTIONAL, SET_VALUED), value, positive, confidence, sequence, authorised.
    """
    def doubt(reason):
        state["unsure"] = True
        return "UNCERTAIN", reason

    if row["confidence"] < 0.5:
        return doubt("LOW_CONFIDENCE_OR_UNKNOWN_POLARITY")
    if state["unsure"]:
        return doubt("AMBIGUOUS_IDENTITY")
    now, operation = state["current"], row["operation"]
    member = row["cardinality"] == "SET_VALUED"
    if operation == "UNKNOWN":
        operation = "ASSERT"
    if member and row["operation"] == "ASSERT" and now is not None and now["positive"] and not row["positive"]:
        operation = "REMOVE"
    if now is not None and (now["value"], now["positive"]) == (row["value"], row["positive"]) and operation != "REMOVE":
        return "MERGE", "SAME_VALUE"
    if operation == "ASSERT" or operation == "ADD":
        if operation == "ADD" and not member:
            return doubt("ADD_TO_FUNCTIONAL_SLOT")
        if now is not None:
            return doubt("ASSERT_DOES_NOT_AUTHORIZE_REPLACEMENT" if operation == "ASSERT" else "ADD_CONFLICTS_WITH_EXISTING_MEMBER")
        state["current"], state["ever"] = row, True
        return ("CREATE", "NEW_ASSERTION") if operation == "ASSERT" else ("ADD", "NEW_MEMBER")
    if member and operation == "REMOVE" and (now is None or not now["positive"] or row["value"] is None):
        return doubt("REMOVE_REQUIRES_POSITIVE_MEMBER_TARGET")
    if operation == "REPLACE" and now is None and not member and not state["ever"] and row["positive"] and row["authorised"]:
        state["current"], state["ever"] = row, True
        return "CREATE", "FIRST_KNOWN_POSTCONDITION"
    if now is None:
        return doubt("MISSING_OR_AMBIGUOUS_DESTRUCTIVE_TARGET")
    if row["sequence"] <= now["sequence"]:
        return doubt("NON_FORWARD_OBSERVATION_ORDER")
    if not row["authorised"]:
        return doubt("UNSUPPORTED_DESTRUCTIVE_HINT")
    if operation == "REMOVE" and not member:
        return doubt("REMOVE_REQUIRES_MEMBER_SLOT")
    state["current"] = {**row, "positive": row["positive"] and operation != "REMOVE"}
    return operation, "GROUNDED_MEMBER_REMOVAL" if operation == "REMOVE" else "GROUNDED_FORWARD_CHANGE"


def frames(rows: DataFrame) -> DataFrame:
    """Proposed changes (slot and the columns of ``frame_step``) with status and reason, in order of sequence."""
    return fold(rows, ["slot"], ["sequence"], lambda: {"current": None, "unsure": False, "ever": False}, frame_step, "status string, reason string")


def batch_step(limit: int):
    def step(state: dict, row: dict) -> tuple:
        if state["size"] and state["size"] + row["length"] + 2 > limit:
            state["batch"], state["size"] = state["batch"] + 1, 0
        state["size"] += row["length"] + 2
        return (str(state["batch"]),)

    return step


def batches(rows: DataFrame, limit: int) -> DataFrame:
    """Records (slot, position, length) with ``batch``: in order, cut where the next record would pass ``limit`` characters."""
    return fold(rows, ["slot"], ["position"], lambda: {"size": 0, "batch": 0}, batch_step(limit), "batch string")
