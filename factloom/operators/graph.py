"""Typed dependency edges: cascades and relational paths by level-synchronous joins."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.durable import cut, written

#: So many levels are gathered before they are written as one.
LEVELS = 12


def cascade(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, within: int | None = None) -> DataFrame:
    """edges (source, target), seeds (node) -> (node, depth): least depth of everything reachable, cycles included once.

    It goes on until a level brings nothing new; a graph deeper than a given ``max_depth`` is an error, and with ``within``
    only what is at most so deep is asked for. Edges are dealt by source once; each level is an equi join of the frontier
    with them, and nodes of earlier levels leave by anti joins, so cycles end. Levels are written to the shared folder, one
    after another; only every so many are they put together. If it is deeper than that and no source has two targets,
    steps are doubled from there on, so that rounds grow with the logarithm of the depth.
    """
    edges = cut(edges.select("source", "target").repartition("source"))
    frontier = written(seeds.select("node", F.lit(0).cast("long").alias("depth")).distinct())
    levels, asked = [frontier], False
    for depth in count(1):
        if within is not None and depth > within:
            break
        step = edges.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        for level in levels:
            step = step.join(level.select("node"), "node", "left_anti")
        frontier = written(step.select("node", F.lit(depth).cast("long").alias("depth")))
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"the graph is deeper than max_depth = {max_depth}")
        levels.append(frontier)
        if len(levels) > LEVELS:
            levels = [written(reduce(DataFrame.unionByName, levels))]
            step = None if asked else only_target(edges)
            asked = True
            if step is not None:
                return _doubled(step, levels[0], depth + 1, max_depth, within)
    return reduce(DataFrame.unionByName, levels)


def only_target(edges: DataFrame) -> DataFrame | None:
    """Each source with its target; None if one has several."""
    many = (F.min("target") != F.max("target")) | (F.count("target") < F.count("*"))
    one = written(edges.where("source is not null").groupBy("source").agg(F.min("target").alias("target"), many.alias("many")))
    return one.select("source", "target") if one.where("many").isEmpty() else None


def _doubled(step: DataFrame, reached: DataFrame, below: int, max_depth: int | None, within: int | None) -> DataFrame:
    """The rest of a cascade from ``reached``, all nodes of depths ``below`` that; ``step`` has one target a source.

    A node that is up to ``width`` deeper is the end of a jump of that width from one that has been reached; the jumps of
    twice the width are two of them. It ends when a jump brings nothing new, since nothing can then be deeper.
    """
    width = 1
    while within is None or below <= within:
        end = reached.join(step.select(F.col("source").alias("node"), "target"), "node").select(F.col("target").alias("node"), (F.col("depth") + width).alias("depth"))
        new = written(end.join(reached.select("node"), "node", "left_anti").groupBy("node").agg(F.min("depth").alias("depth")))
        if new.isEmpty():
            break
        below += width
        reached = written(reached.unionByName(new))
        if max_depth is not None and not reached.where(F.col("depth") > max_depth).isEmpty():
            raise RuntimeError(f"the graph is deeper than max_depth = {max_depth}")
        if below > width * 2:
            step = written(step.join(step.select(F.col("source").alias("target"), F.col("target").alias("end")), "target").select("source", F.col("end").alias("target")))
            width *= 2
    return reached if within is None else reached.where(F.col("depth") <= within)


def protected_cascade(edges: DataFrame, seeds: DataFrame, protected: DataFrame, max_depth: int | None = None) -> DataFrame:
    """As ``cascade``, but protected nodes neither fall nor pass it on."""
    open_edges = edges.join(protected.select(F.col("node").alias("target")), "target", "left_anti")
    return cascade(open_edges, seeds, max_depth)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (source, target), walked either way, connect a node with.

    A round takes the least label of the neighbours, for the node and for the node that its label names, and then the
    label of the label: whole components hook on to a lesser one, so rounds grow with the logarithm of a chain in any
    order of its nodes. Each round is written to the shared folder. It ends when no label changes.
    """
    both = cut(undirected(written(edges.select("source", "target").where("source <> target"))).repartition("source"))
    now = written(both.groupBy(F.col("source").alias("node")).agg(F.least(F.min("target"), F.first("source")).alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("target"), "label"), "target").groupBy(F.col("source").alias("node")).agg(F.min("label").alias("near"))
        own = F.struct("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        hook = F.struct(F.col("label").alias("node"), F.col("near").alias("label"), F.lit(None).alias("was"))
        step = now.join(near, "node").select(F.explode(F.array(own, hook)).alias("x")).groupBy("x.node").agg(F.min("x.label").alias("label"), F.max("x.was").alias("was"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = written(step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label")))
        now = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return now


def two_hops(triples: DataFrame) -> DataFrame:
    """Paths subject -> middle -> object over facts, not returning to the subject."""
    a = triples.select("subject", F.col("relation").alias("first"), F.col("object").alias("middle"))
    b = triples.select(F.col("subject").alias("middle"), F.col("relation").alias("second"), "object")
    return a.join(b, "middle").where("subject <> object").select("subject", "first", "middle", "second", "object")


def antisymmetric(assessed: DataFrame) -> DataFrame:
    """Of A->B and B->A the stronger stays: strength, confidence, then the smaller source."""
    lo, hi = F.least("source", "target"), F.greatest("source", "target")
    best = F.max_by(F.struct("source", "target", "strength", "confidence"), F.struct("strength", "confidence", -F.col("source")))
    return assessed.groupBy(lo.alias("lo"), hi.alias("hi")).agg(best.alias("b")).select("b.*")
