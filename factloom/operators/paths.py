"""Paths over facts from an anchor to a goal relation: one equi join a hop, the best path of each anchor by one aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.durable import written


def hint_index(index: Column, relation: Column, hints: list[str]) -> Column:
    """One more where the relation is the next hint in order."""
    step = F.lit(False)
    for i, h in enumerate(hints):
        step = step | ((index == i) & (relation == h))
    return index + step.cast("int")


def barred(kept: list, own: tuple[set, set], left: tuple[int, int]) -> bool:
    """Whether some way here bars all ``kept`` ways on but not one's own: it has a fact or an entity of each, of which it may hold so many (``left``).

    A way is (facts, entities). It is enough to try the facts and entities of one that isn't barred yet.
    """
    if not kept:
        return True
    for kind in (0, 1):
        for x in kept[0][kind] - own[kind] if left[kind] else ():
            rest = [k for k in kept if x not in k[kind]]
            if barred(rest, own, (left[0] - (kind == 0), left[1] - (kind == 1))):
                return True
    return False


def thinned(ways: DataFrame, before: int, close: float) -> DataFrame:
    """Of the ways of one length on from a node with the same hints met, those that can be part of a best path when up to ``before`` facts lead to it.

    A worse one stays only if there is a way to the node that has a fact or an entity of each better one and none of its
    own; the facts that lead to a node stand on as many entities. So a few stay, whatever number there is, and none that
    could win goes. One shuffle; a node's ways are read in order, best first, and those that stay are held. Sums within
    ``close`` of each other may compare otherwise when they are added up from the other end, so both stay.
    """
    key = ["at", "met"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            stays = np.ones(len(names), dtype=bool)
            # a node's only way stays
            looked = [i for i, k in enumerate(names) if k == now or i in (0, len(names) - 1) or k in (names[i - 1], names[i + 1])]
            for i, row in zip(looked, batch.take(pa.array(looked, pa.int64())).to_pylist(), strict=True):
                if names[i] != now:
                    now, kept = names[i], []
                own = (set(row["path"]), set(row["seen"]))
                surely = lambda k, row=row: k["n_hints"] > row["n_hints"] or k["score"] - row["score"] > close or (k["gains"] == row["gains"] and k["path"] <= row["path"])
                stays[i] = barred([items for k, items in kept if surely(k)], own, (before, before))
                if stays[i]:
                    kept.append((row, own))
            yield batch.filter(pa.array(stays))

    order = ways.repartition(*key).sortWithinPartitions(*key, F.desc("n_hints"), F.desc("score"), "path")
    return order.mapInArrow(run, ways.schema)


def from_the_goal(step: DataFrame, anchors: DataFrame, goal: str, hints: list[str], max_hops: int, most: float) -> DataFrame:
    """The paths of ``goal_paths`` that can be an anchor's best (anchor, path, target, hops, n_hints, score), found from the goal backwards.

    Ways on from a node are the same for all anchors, so they are made once: those of one fact more are a fact and a way
    on from its object. Few stay for a node (``thinned``), so a hop has about as many rows as there are facts, also
    through hubs. Only nodes that anchors reach, with the hints that may be met by then, are looked at.
    """
    on = step.where(F.col("relation") != goal)
    # what rounding can take from a difference of sums of max_hops scores
    close = max_hops**2 * most * 2.0**-50
    front = written(anchors.select(F.col("anchor").alias("at"), F.lit(0).alias("met"), F.lit(0).alias("hop")).distinct())
    reach, start = front, front.select(F.col("at").alias("anchor"))
    for hop in range(1, max_hops):
        there = front.join(on, "at").select(F.col("object").alias("at"), hint_index(F.col("met"), F.col("relation"), hints).alias("met"), F.lit(hop).alias("hop")).distinct()
        front = written(there.join(reach, ["at", "met"], "left_anti"))
        reach = reach.unionByName(front)
    met = lambda df: hint_index(df["met"], df["relation"], hints)
    last = step.where(F.col("relation") == goal).join(reach, "at")
    way = last.select("at", "met", F.array("state_id").alias("path"), F.array().cast("array<string>").alias("seen"), F.array("gain").alias("gains"), met(last).alias("n_hints"), F.col("object").alias("target"), F.col("gain").alias("score"))
    found = None
    for length in range(1, max_hops + 1):
        if length > 1:
            first = on.join(reach.where(F.col("hop") <= max_hops - length), "at")
            first = first.select(F.col("at").alias("_at"), F.col("met").alias("_met"), F.col("object").alias("at"), met(first).alias("met"), "state_id", "gain")
            both = first.join(way, ["at", "met"]).where((F.col("_at") != F.col("at")) & ~F.array_contains("path", F.col("state_id")) & ~F.array_contains("seen", F.col("_at")))
            ahead = lambda x, c: F.concat(F.array(x), c).alias(c)
            way = both.select(F.col("_at").alias("at"), F.col("_met").alias("met"), ahead("state_id", "path"), ahead("at", "seen"), ahead("gain", "gains"), "n_hints", "target", (F.col("gain") + F.col("score")).alias("score"))
        if length < max_hops:
            way = written(thinned(way, max_hops - length, close))
        # added up from the anchor on, as a walk does
        score = F.aggregate("gains", F.lit(0.0), lambda a, x: a + x)
        done = way.where("met = 0").join(start, F.col("at") == F.col("anchor")).select("anchor", "path", "target", F.lit(length).alias("hops"), "n_hints", score.alias("score"))
        found = done if found is None else found.unionByName(done)
    return found


def goal_paths(facts: DataFrame, anchors: DataFrame, goal: str, hints: list[str] | None = None, blocked: DataFrame | None = None, max_hops: int = 3, prune: bool = False) -> DataFrame:
    """anchor, path (state ids), target, hops, n_hints, score: the best path of at most ``max_hops`` facts to the goal.

    facts: subject, relation, object, state_id, score. anchors: anchor. blocked: anchor, entity (entities that only
    superseded facts of the anchor lead to; a path may end in one but not go on from it). Any relation may be walked on;
    entities and facts occur once in a path. Best: most hints met in order, then the higher sum of scores, then fewer
    hops, then the lesser state ids. A hop's rows are the paths there are, so a subject with many objects costs as many;
    with ``prune`` paths are found from the goal backwards, without those that can't be an anchor's best (see
    ``from_the_goal``), so a hop costs as the facts do, whatever hubs lie between, and the result is the same. (Where
    something is blocked, or a score is no finite number, all paths are walked.) A hop takes only facts of the goal and
    those to an entity from which a fact of the goal is still in reach: hubs that lead nowhere in the hops left are not
    walked to.
    """
    hints = hints or []
    # the facts are read for each hop, a hop for its goals and for the next one
    step = written(facts.select(F.col("subject").alias("at"), "relation", "object", "state_id", F.col("score").cast("double").alias("gain")))
    best = F.min(F.struct((-F.col("n_hints")).alias("a"), (-F.col("score")).alias("b"), "hops", "path", "target"))
    of_each = lambda found: found.groupBy("anchor").agg(best.alias("m")).select("anchor", F.array_join("m.path", ">").alias("path"), "m.target", F.col("m.hops").cast("long").alias("hops"), (-F.col("m.a")).cast("long").alias("n_hints"), F.round(-F.col("m.b"), 6).alias("score"))
    if prune and blocked is None:
        most, odd = step.agg(F.max(F.abs("gain")), F.bool_or(F.col("gain").isNull() | F.isnan("gain") | F.abs("gain").isin(float("inf")))).first()
        if not odd:
            return of_each(from_the_goal(step, anchors, goal, hints, max_hops, most or 0.0))
    none = F.array().cast("array<string>")
    front = anchors.select("anchor", F.col("anchor").alias("at"), none.alias("path"), F.array("anchor").alias("seen"), F.lit(0).alias("n_hints"), F.lit(0.0).alias("score"))
    found = None
    # ahead[r]: from where a fact of the goal is at most r hops away
    aim = F.col("relation") == goal
    ahead = [written(step.where(aim).select("at").distinct())]
    for _ in range(max_hops - 2):
        before = step.where(~aim).join(ahead[-1].select(F.col("at").alias("object")), "object", "left_semi").select("at")
        ahead.append(written(before.union(ahead[-1]).distinct()))
    for hop in range(1, max_hops + 1):
        onward = step.where(aim)
        if hop < max_hops:
            onward = onward.unionByName(step.where(~aim).join(ahead[max_hops - hop - 1].select(F.col("at").alias("object")), "object", "left_semi").select(*step.columns))
        walked = front.join(onward, "at").where(~F.array_contains("path", F.col("state_id")))
        walked = written(walked.select("anchor", F.col("object").alias("at"), "relation", F.concat("path", F.array("state_id")).alias("path"), "seen", hint_index(F.col("n_hints"), F.col("relation"), hints).alias("n_hints"), (F.col("score") + F.col("gain")).alias("score")))
        done = walked.where(F.col("relation") == goal).select("anchor", "path", F.col("at").alias("target"), F.lit(hop).alias("hops"), "n_hints", "score")
        found = done if found is None else found.unionByName(done)
        front = walked.where((F.col("relation") != goal) & ~F.array_contains("seen", F.col("at"))).select("anchor", "at", "path", F.concat("seen", F.array("at")).alias("seen"), "n_hints", "score")
        if blocked is not None:
            front = front.join(blocked.select("anchor", F.col("entity").alias("at")).distinct(), ["anchor", "at"], "left_anti").select(*front.columns)
    return of_each(found)
