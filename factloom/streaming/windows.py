"""Windowed aggregates that run alike on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    src = events.withWatermark("ts", late) if late else events
    return src.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Gaps and islands per user: a gap of at least ``gap_minutes`` opens a session."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) >= F.make_dt_interval(mins=F.lit(gap_minutes))
    marked = events.withColumn("opens", F.coalesce(gap.cast("long"), F.lit(1))).withColumn("session", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def stream_tumbling(spark, path: str, schema, out: str, checkpoint: str, size: str = "1 hour", late: str = "10 minutes", glob: str = "*"):
    """The tumbling aggregate as a stream of the Parquet files in a folder; returns the started query (append mode, closed windows)."""
    src = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return tumbling(src.withColumn("ts", F.col("ts").cast("timestamp")), size, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int, span: int = 1000) -> DataFrame:
    """rows with ``used``, the running sum of ``size`` in order, while it is within the budget.

    Sums of spans of the (integer) order are totalled first; only spans that begin within the budget are summed row by
    row, so a group with a third of all rows brings a few spans to one task, not its rows.
    """
    spans = rows.withColumn("_span", F.floor(F.col(order) / span))
    w = W.partitionBy(group).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    begins = spans.groupBy(group, "_span").agg(F.sum(size).alias("_sum")).withColumn("_begin", F.coalesce(F.sum("_sum").over(w), F.lit(0))).where(F.col("_begin") <= budget)
    inner = W.partitionBy(group, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = spans.join(begins.select(group, "_span", "_begin"), [group, "_span"]).withColumn("used", (F.col("_begin") + F.sum(size).over(inner)).cast("long"))
    return out.where(F.col("used") <= budget).drop("_span", "_begin")
