"""What a question's answer may read: retrieved items in order, to a number of items and of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bounded(items: DataFrame, max_items: int = 10, max_characters: int = 64_000) -> DataFrame:
    """question_id, n (from 1), place, text of what fits.

    items: question_id, place (unique in a question), text (null: empty). Of the first ``max_items`` by place, those that aren't empty
    go in whole while the code points last; the one that doesn't fit is cut there and is the last.
    """
    w = W.partitionBy("question_id").orderBy("place")
    first = items.select("question_id", "place", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(w).alias("_i")).where(F.col("_i") <= max_items)
    size = F.length("text").cast("long")
    before = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)) - size
    fit = first.select("question_id", "place", "text", before.alias("_before")).where((F.col("text") != "") & (F.col("_before") < max_characters))
    text = F.substring("text", F.lit(1), (max_characters - F.col("_before")).cast("int"))
    return fit.select("question_id", F.row_number().over(w).cast("long").alias("n"), "place", text.alias("text"))


def contexts(items: DataFrame, max_items: int = 10, max_characters: int = 64_000) -> DataFrame:
    """question_id, context ("[1] ..." and so on, an empty line between), source_items, used_items, used_characters, estimated_tokens (four characters each), truncated of every question with items.

    ``truncated``: there were more items, or more characters in those that count.
    """
    w = W.partitionBy("question_id").orderBy("place")
    sized = items.select("question_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_size"), F.row_number().over(w).alias("_i"))
    had = sized.groupBy("question_id").agg(F.count("*").alias("source_items"), F.sum(F.when(F.col("_i") <= max_items, F.col("_size"))).alias("_size"))
    used = bounded(items, max_items, max_characters).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("_t"), F.sum(F.length("text")).cast("long").alias("used_characters"))
    lines = F.transform(F.coalesce("_t", F.array().cast("array<struct<n:bigint,text:string>>")), lambda t: F.concat(F.lit("["), t["n"].cast("string"), F.lit("] "), t["text"]))
    c = had.join(used, "question_id", "left").withColumn("used_characters", F.coalesce("used_characters", F.lit(0)))
    more = (F.col("source_items") > max_items) | (F.col("_size") > max_characters)
    return c.select("question_id", F.array_join(lines, "\n\n").alias("context"), "source_items", F.size(lines).cast("long").alias("used_items"), "used_characters", F.floor((F.col("used_characters") + 3) / 4).alias("estimated_tokens"), more.alias("truncated"))
