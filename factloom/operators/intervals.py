"""Intervals by sweeps: overlaps within slots, unions, gaps, and the chunk that contains a range. No interval meets all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def overlapping(rows: DataFrame, keys: list[str], label: str = "cond", every: bool = False) -> DataFrame:
    """Rows (keys, id, t0, t1, label) that overlap an earlier one of their keys whose label goes with theirs: id, other.

    Half-open intervals, null bounds unbounded. Labels are arrays of (key, value); two go together unless a key they
    share has two values. Within keys only the distinct labels meet each other, and each pair of labels that go together
    is one sweep by start that remembers the greatest end so far of the other label, so a row costs as many steps as its
    slot has labels, never as many as it has rows. ``other`` is the row with that end, the least of those for all labels;
    ``every``: a row for each of them, so that the pairs connect what overlaps, directly or over others.
    """
    labels = rows.select(*keys, label).distinct()
    both = labels.join(labels.withColumnRenamed(label, "_with"), keys)
    clash = F.exists(label, lambda x: F.exists("_with", lambda y: (x["key"] == y["key"]) & (x["value"] != y["value"])))
    own = rows.join(both.where(~clash), [*keys, label])
    low, high = F.least(F.to_json(label), F.to_json("_with")), F.greatest(F.to_json(label), F.to_json("_with"))
    own = own.select(*keys, "id", "t0", "t1", low.alias("_low"), high.alias("_high"), (F.to_json(label) == low).alias("_first"))
    # an open end is later than any other
    end = F.struct(F.col("t1").isNull().alias("open"), F.col("t1").alias("at"), F.col("id").alias("id"))
    w = W.partitionBy(*keys, "_low", "_high").orderBy(F.asc_nulls_first("t0"), F.asc_nulls_last("t1"), "id").rowsBetween(W.unboundedPreceding, -1)
    of = lambda c: F.max(F.when(c, end)).over(w)
    same = F.col("_low") == F.col("_high")
    swept = own.withColumn("_one", of(same | F.col("_first"))).withColumn("_two", of(same | ~F.col("_first")))
    before = F.when(same | ~F.col("_first"), F.col("_one")).otherwise(F.col("_two"))
    swept = swept.withColumn("_before", before).where("_before is not null and (_before.open or t0 is null or _before.at > t0)")
    if every:
        return swept.select(*keys, "id", F.col("_before.id").alias("other")).distinct()
    return swept.groupBy(*keys, "id").agg(F.min("_before.id").alias("other"))


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The union of ranges (keys, start, end) as maximal ranges; empty ones are left out, touching ones join."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    r = ranges.where("end > start").select(*keys, "start", "end").distinct()
    opens = F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_opens", F.coalesce(opens, F.lit(True)).cast("int"))
    r = r.withColumn("_island", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def gaps(ranges: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """What the ranges leave of [0, length) of each row of ``whole`` (keys, length), as maximal ranges."""
    clipped = ranges.join(whole, keys).select(*keys, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end")).where("end > start")
    union = merged(clipped, keys)
    edges = union.select(*keys, "start", "end").unionByName(whole.select(*keys, F.col("length").alias("start"), F.col("length").alias("end")))
    w = W.partitionBy(*keys).orderBy("start", "end")
    return edges.select(*keys, F.coalesce(F.lag("end").over(w), F.lit(0)).cast("long").alias("start"), F.col("start").cast("long").alias("end")).where("end > start")


def containing(ranges: DataFrame, chunks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """ranges (keys, range_id, start, end) with the chunk that holds the whole of each: chunk_id, n_chunks, how.

    chunks: keys, chunk_id, chunk_start, chunk_end. Chunks are dealt to bins of ``width`` positions, each to all that it
    touches, and a range to the bin of its start, so the join is one of equal bins. Where exactly one chunk holds a
    range it is CONTAINED; where several do, the first one by start is taken (FIRST); where none does, the one that
    shares most of it, the first of equals (OVERLAP); where it meets none, chunk_id is null (NONE).
    """
    bin_of = lambda c: F.floor(F.col(c) / width)
    last = F.greatest(F.col("chunk_start"), F.col("chunk_end") - 1)
    dealt = chunks.withColumn("_bin", F.explode(F.sequence(bin_of("chunk_start"), F.floor(last / width))))
    # a range that no chunk holds may meet chunks in any of its bins
    spread = ranges.withColumn("_bin", F.explode(F.sequence(bin_of("start"), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / width))))
    pair = spread.join(dealt, [*keys, "_bin"]).select(*keys, "range_id", "start", "end", "chunk_id", "chunk_start", "chunk_end")
    shared = F.least("end", "chunk_end") - F.greatest("start", "chunk_start")
    holds = (F.col("chunk_start") <= F.col("start")) & (F.col("end") <= F.col("chunk_end"))
    met = pair.select("*", shared.alias("_shared"), holds.alias("_holds")).where("_shared > 0 or _holds")
    best = F.min(F.struct((~F.col("_holds")).alias("a"), F.when(F.col("_holds"), 0).otherwise(-F.col("_shared")).alias("b"), "chunk_start", "chunk_id"))
    found = met.groupBy(*keys, "range_id").agg(best.alias("_best"), F.size(F.collect_set(F.when(F.col("_holds"), F.col("chunk_id")))).cast("long").alias("n_chunks"))
    out = ranges.join(found, [*keys, "range_id"], "left")
    n = F.coalesce("n_chunks", F.lit(0))
    how = F.when(n == 1, "CONTAINED").when(n > 1, "FIRST").when(F.col("_best").isNotNull(), "OVERLAP").otherwise("NONE")
    return out.select(*ranges.columns, F.col("_best.chunk_id").alias("chunk_id"), n.alias("n_chunks"), how.alias("how"))
