"""Set and token metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    """precision, recall, f1; nothing predicted and nothing expected is perfect."""
    empty = (predicted == 0) & (gold == 0)
    p = F.when(empty, 1.0).when(predicted == 0, 0.0).otherwise(tp / predicted)
    r = F.when(empty, 1.0).when(gold == 0, 0.0).otherwise(tp / gold)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def token_f1(pairs: DataFrame, prediction: str, reference: str, key: str) -> DataFrame:
    """Bag-of-tokens F1 of two token-array columns, by counting shared tokens per key."""
    count = lambda c, n: pairs.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias(n))
    shared = count(prediction, "p").join(count(reference, "r"), [key, "t"]).groupBy(key).agg(F.sum(F.least("p", "r")).alias("tp"))
    both = pairs.select(key, F.size(prediction).alias("n_p"), F.size(reference).alias("n_r")).join(shared, key, "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return both.select(key, *prf(F.col("tp"), F.col("n_p"), F.col("n_r")))
