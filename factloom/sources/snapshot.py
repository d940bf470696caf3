"""Snapshots of states as canonical JSON lines, and the commit log that says where to go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

FORMAT = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def lines(states: DataFrame) -> DataFrame:
    """digest, line: one JSON object for each row, fields in order of their names, nulls written."""
    line = F.to_json(F.struct(*sorted(states.columns)), FORMAT)
    return states.select(F.sha2(line, 256).alias("digest"), line.alias("line"))


def restored(snapshot: DataFrame, schema: StructType) -> DataFrame:
    """The rows of a snapshot; a line whose digest doesn't match, or that doesn't parse, is an error."""
    ok = snapshot.select(F.when(F.sha2("line", 256) == F.col("digest"), F.col("line")).otherwise(F.raise_error(F.lit("snapshot line is damaged"))).alias("line"))
    return ok.select(F.from_json("line", schema, {**FORMAT, "mode": "FAILFAST"}).alias("s")).select("s.*")


def write(states: DataFrame, path: str) -> None:
    lines(states).write.mode("overwrite").parquet(path)


def contiguous(log: DataFrame) -> DataFrame:
    """entity, last_committed, status of logs (entity, position, claimed): commits count up to the first gap."""
    first = F.min(F.when(F.col("claimed") != F.col("position"), F.col("position")))
    g = log.groupBy("entity").agg(first.alias("broken"), F.count("*").alias("n"))
    return g.select("entity", (F.coalesce("broken", "n") - 1).alias("last_committed"), F.when(F.col("broken").isNull(), "COMMITTED").otherwise("NON_CONTIGUOUS").alias("status"))


def observation_index(log: DataFrame) -> DataFrame:
    """log (group_id, observation_id, position) with observation_index: order of first arrival in the group, so a replay keeps its index."""
    first = F.min("position").over(W.partitionBy("group_id", "observation_id"))
    return log.withColumn("_first", first).withColumn("observation_index", (F.dense_rank().over(W.partitionBy("group_id").orderBy("_first", "observation_id")) - 1).cast("long")).drop("_first")


def lossless(ranges: DataFrame, key: str) -> DataFrame:
    """key, n_ranges, n_repeated, lossless of ranges (key, start, end, length), overlaps allowed.

    Lossless: they begin at 0, leave no gap and end at the length. n_repeated counts what overlaps cover again.
    """
    w = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    r = ranges.withColumn("reached", F.coalesce(F.max("end").over(w), F.lit(0)))
    bad = (F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("length")) | (F.col("start") > F.col("reached"))
    again = F.greatest(F.lit(0), F.least("end", "reached") - F.col("start"))
    whole = ~F.bool_or(bad) & (F.max("end") == F.max("length"))
    return r.groupBy(key).agg(F.count("*").alias("n_ranges"), F.sum(again).cast("long").alias("n_repeated"), whole.alias("lossless"))
