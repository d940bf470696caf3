"""Connected components of an edge table by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, release
from factloom.sources.durable import written

#: Edges that ``contracted`` replaces at a time.
CHUNK = 500_000


def stars(a: np.ndarray, b: np.ndarray):
    """(node, least node of its component), where they differ, of the components of these edges alone."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[u], label[v])
        np.minimum.at(low, label[v], label[u])
        low = low[low[low]]
        new = np.minimum(low[label], low)
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def contracted(edges: DataFrame) -> DataFrame:
    """An edge table with the same components: runs of edges of a partition become stars, which saves rounds."""

    def run(batches):
        held, size = [], 0

        def flush():
            a, b = (np.concatenate([x[i].to_numpy() for x in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0), batch.column(1)))
            size += batch.num_rows
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """edges (a, b) -> (node, label): label is the smallest node of the component.

    Each round takes the least label among neighbours (partial aggregation, so a hub costs a row per task), for the node
    and for the node that its label names, and then jumps to the label's own label, so rounds grow with the logarithm of
    a chain. Label tables are files, whose sizes Spark knows, also after many rounds. Nulls and self-loops are dropped; an empty table gives no rows.
    """
    spark = edges.sparkSession
    e = cut(contracted(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")))
    both = cut(e.union(e.select(F.col("b"), F.col("a"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        own = F.struct("node", F.least("label", F.coalesce("m", "label")).alias("next"), F.col("label").alias("old"))
        hook = F.struct(F.col("label").alias("node"), F.coalesce("m", "label").alias("next"), F.lit(None).cast("long").alias("old"))
        step = labels.join(near, "node", "left").select(F.explode(F.array(own, hook)).alias("x")).groupBy("x.node").agg(F.min("x.next").alias("next"), F.max("x.old").alias("old"))
        up = step.select(F.col("node").alias("next"), F.col("next").alias("top"))
        new = written(step.join(up, "next", "left").select("node", F.least("next", F.coalesce("top", "next")).alias("label"), "old"))
        moved = not new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not moved:
            release(spark)
            return labels
    raise RuntimeError("components did not settle")
