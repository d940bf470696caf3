"""Filling of retrievals: anchors that cover a question's intents first, then what they depend on, to a fixed number.

Many questions at once. Neighbours are ranked per question and state and cut to what a fill can look at before any of
them is joined on, so a hub's edges never leave its rank window; the fill itself, which depends on the order of choices,
runs over the few rows that are left of a question.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.sources.durable import cut

QUESTION = "question_id"


def coverage(overlaps: DataFrame) -> DataFrame:
    """question_id, state_id, intent: the states that cover each intent best.

    overlaps: question_id, state_id, intent (0, 1, ...), overlap. Intents take their states in order: of those that no
    earlier intent has taken, all that share the greatest overlap above 0.
    """
    left = cut(overlaps.where("overlap > 0"))
    most = left.agg(F.max("intent")).first()[0]
    taken = None
    for i in range(0 if most is None else most + 1):
        mine = left.where(F.col("intent") == i)
        if taken is not None:
            mine = mine.join(taken.select(QUESTION, "state_id"), [QUESTION, "state_id"], "left_anti")
        best = mine.join(mine.groupBy(QUESTION).agg(F.max("overlap").alias("_best")), QUESTION).where("overlap = _best").select(QUESTION, "state_id", "intent").distinct()
        taken = best if taken is None else taken.unionByName(best)
    return taken if taken is not None else left.select(QUESTION, "state_id", "intent")


def _one(anchors: list[dict], near: dict[str, list[tuple]], limit: int, depth: int, beam: int) -> list[tuple]:
    """The fill of one question: (state, place, via, relation, depth)."""
    out: dict[str, tuple] = {}

    def take(state, via=None, relation=None, level=0):
        if len(out) < limit and state not in out:
            out[state] = (len(out) + 1, via, relation, level)
            return True
        return False

    def expand(state):
        queue = [(state, 0)]
        while queue and len(out) < limit:
            source, level = queue.pop(0)
            if level < depth:
                fresh = [x for x in near.get(source, []) if x[0] not in out][:beam]
                queue += [(target, level + 1) for target, relation in fresh if take(target, source, relation, level + 1)]

    first = [a for a in anchors if a["kind"] < 2]
    for a in first:
        take(a["state_id"])
    for a in first:
        if a["kind"] == 0:
            expand(a["state_id"])
    for a in anchors:
        if a["kind"] > 0 and take(a["state_id"]):
            expand(a["state_id"])
    return [(s, *x) for s, x in out.items()]


def fill(ranked: DataFrame, edges: DataFrame, limit: int = 10, depth: int = 2, beam: int = 4) -> DataFrame:
    """question_id, place (from 1), state_id, via, relation, level of the states chosen for each question.

    ranked: question_id, state_id, rank (the least is best, unique in a question; a struct to sort by saves numbering all
    states of a question in one task), relevant, intent (of ``coverage``, else null),
    provenance (a sibling of the question's anchor). edges: source, target, relation_type, walked both ways. First the
    covering states go in by intent and rank, then the siblings; then each covering state is expanded, breadth first to
    ``depth``, along at most ``beam`` edges a state to states not yet chosen, depends-on before others and then by rank;
    then the other relevant states by rank, each expanded in turn. It ends at ``limit``.
    """
    wide = limit + beam  # of a state's neighbours at most limit are taken already, so no others can be in its beam
    anchor_kind = F.when(F.col("intent").isNotNull(), 0).when(F.col("provenance"), 1).when(F.col("relevant"), 2)
    a = ranked.withColumn("kind", anchor_kind).where("kind is not null")
    order = W.partitionBy(QUESTION).orderBy("kind", F.when(F.col("kind") == 0, F.col("intent")).otherwise(0), "rank")
    # limit anchors and, of the relevant ones, as many more as earlier choices may already hold
    a = cut(a.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * limit).select(QUESTION, "state_id", "kind", "_n"))
    both = edges.select(F.col("source").alias("state_id"), F.col("target").alias("other"), "relation_type").unionByName(edges.select(F.col("target").alias("state_id"), F.col("source").alias("other"), "relation_type"))
    places = ranked.select(QUESTION, F.col("state_id").alias("other"), "rank")
    front, near = a.select(QUESTION, "state_id").distinct(), None
    for _ in range(depth):
        met = front.join(both, "state_id").join(places, [QUESTION, "other"])
        least = F.min(F.struct((F.col("relation_type") != "depends-on").cast("int").alias("late"), "rank", "relation_type")).alias("m")
        met = met.groupBy(QUESTION, "state_id", "other").agg(least)
        first = F.row_number().over(W.partitionBy(QUESTION, "state_id").orderBy("m.late", "m.rank"))
        met = cut(met.withColumn("_n", first).where(F.col("_n") <= wide).select(QUESTION, "state_id", "other", "_n", F.col("m.relation_type").alias("relation")))
        near = met if near is None else near.unionByName(met)
        front = met.select(QUESTION, F.col("other").alias("state_id")).distinct().join(near.select(QUESTION, "state_id").distinct(), [QUESTION, "state_id"], "left_anti")
    kind = ranked.schema["state_id"].dataType.simpleString()
    text = lambda c: F.col(c).cast("string")
    rows = a.select(QUESTION, text("state_id").alias("state_id"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("relation"), "kind", "_n")
    rows = rows.unionByName(near.select(QUESTION, text("state_id").alias("state_id"), text("other").alias("other"), "relation", F.lit(9).alias("kind"), "_n"))

    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        anchors = rows[rows["kind"] < 9][["state_id", "kind"]].to_dict("records")
        near: dict[str, list[tuple]] = {}
        for r in rows[rows["kind"] == 9].itertuples():
            near.setdefault(r.state_id, []).append((r.other, r.relation))
        out = pd.DataFrame(_one(anchors, near, limit, depth, beam), columns=["state_id", "place", "via", "relation", "level"])
        out.insert(0, QUESTION, [key[0]] * len(out))
        return out

    schema = f"{QUESTION} {ranked.schema[QUESTION].dataType.simpleString()}, state_id string, place long, via string, relation string, level long"
    done = rows.groupBy(QUESTION).applyInPandas(work, schema)
    return done.select(QUESTION, "place", F.col("state_id").cast(kind).alias("state_id"), F.col("via").cast(kind).alias("via"), "relation", "level")
