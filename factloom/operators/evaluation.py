"""Scores of predictions: sets of invalidated states, answers against references, remembered and forgotten items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: ASCII punctuation, articles and the answers that are right or wrong as a whole.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPECIAL = ("yes", "no", "noanswer")


def answer_words(c: Column) -> Column:
    """Lower-cased words without ASCII punctuation and articles."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(text, r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))


def _numbered(p: DataFrame, words: str) -> DataFrame:
    """p with ``words`` as a set: each word with its number among its equals, so that two sets share what two bags do."""
    s = p.withColumn(words, F.array_sort(words))
    at = F.array_compact(F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1) != w), i)))
    n = lambda a, j: F.coalesce(F.get("_at", j + 1), F.size(words)) - a
    runs = F.transform("_at", lambda a, j: F.transform(F.sequence(F.lit(1), n(a, j)), lambda k: F.concat_ws(" ", F.get(words, a), k.cast("string"))))
    return s.withColumn("_at", at).withColumn(words, F.flatten(runs)).drop("_at")


def _shared(p: DataFrame, key: list[str]) -> DataFrame:
    """p with tp, the words that p and r share; rows of one key count together."""
    one = p.where("_rows = 1").withColumn("_p", F.col("p")).withColumn("_r", F.col("r"))
    one = _numbered(_numbered(one, "_p"), "_r").withColumn("tp", F.size(F.array_intersect("_p", "_r")).cast("long")).drop("_p", "_r")
    several = p.where("_rows > 1")
    mark = lambda c, a: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(a).alias("a")))
    said = several.select(*key, F.explode(F.concat(mark("p", True), mark("r", False))).alias("x")).select(*key, "x.*")
    said = said.groupBy(*key, "w").agg(F.count_if("a").alias("np"), F.count_if(~F.col("a")).alias("nr"))
    both = said.groupBy(*key).agg(F.sum(F.least("np", "nr")).alias("tp"))
    # sizes of files of like texts say little, so nothing is sent to all tasks on their word
    more = several.join(both.hint("merge"), key, "left")
    return one.unionByName(more.select(*one.columns))


def answer_f1(pairs: DataFrame, key: list[str], prediction: str, reference: str) -> DataFrame:
    """key, exact, contained, f1 of answers, by the words shared in each key, within the row where a key has one."""
    if "_rows" not in pairs.columns:
        pairs = pairs.withColumn("_rows", F.count("*").over(W.partitionBy(*key)))
    p = pairs.select(*key, "_rows", answer_words(F.col(prediction)).alias("p"), answer_words(F.col(reference)).alias("r"))
    p = _shared(p, key).withColumn("tp", F.coalesce("tp", F.lit(0)))
    a, b = F.array_join("p", " "), F.array_join("r", " ")
    whole = (a.isin(*SPECIAL) | b.isin(*SPECIAL)) & (a != b)
    f1 = F.when(whole, 0.0).when((F.size("p") == 0) | (F.size("r") == 0), (a == b).cast("double")).when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.size("p") + F.size("r")))
    return p.select(*key, (a == b).cast("double").alias("exact"), F.contains(a, b).cast("double").alias("contained"), F.round(f1, 6).alias("f1"))


def set_scores(predicted: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """key, tp, fp, fn, precision, recall of item sets; nothing predicted and nothing expected is perfect."""
    p = predicted.select(key, item).distinct().withColumn("p", F.lit(1))
    e = expected.select(key, item).distinct().withColumn("e", F.lit(1))
    g = p.join(e, [key, item], "full").groupBy(key).agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    rate = lambda n: F.when(F.col("tp") + F.col(n) > 0, F.col("tp") / (F.col("tp") + F.col(n))).otherwise((F.col("tp") + F.col("fp") + F.col("fn") == 0).cast("double"))
    return g.select(key, "tp", "fp", "fn", F.round(rate("fp"), 6).alias("precision"), F.round(rate("fn"), 6).alias("recall"))


def fama(judged: DataFrame, key: str) -> DataFrame:
    """Presence accuracy less the weighted failures to forget. judged: key, kind (presence, absence), correct (0/1)."""
    presence = F.avg(F.when(F.col("kind") == "presence", F.col("correct")))
    absence = F.coalesce(F.avg(F.when(F.col("kind") == "absence", F.col("correct"))), F.lit(1.0))
    weight = F.count_if(F.col("kind") == "absence") / F.count("*")
    g = judged.groupBy(key).agg(presence.alias("mpa"), absence.alias("faa"), weight.alias("weight"))
    score = F.greatest(F.lit(0.0), F.col("mpa") - F.col("weight") * (1 - F.col("faa")))
    return g.select(key, *[F.round(c, 6).alias(c) for c in ("mpa", "faa", "weight")], F.round(score, 6).alias("fama"))


def error_class(status: Column, message: Column) -> Column:
    """Class of an execution failure by its status code, then by its message."""
    quota = F.contains(message, F.lit("quota")) | F.contains(message, F.lit("credit_balance"))
    return (
        F.when(status == 429, F.when(quota, "other").otherwise("tpm_rate_limit"))
        .when(status.isin(408, 504), "timeout")
        .when(status.isin(500, 502, 503), "transport_failure")
        .when(F.contains(message, F.lit("invalid json")) | F.contains(message, F.lit("malformed structured")), "malformed_structured_output")
        .otherwise("other")
    )


def multiset_diff(old: DataFrame, new: DataFrame, group: str, item: list[str]) -> DataFrame:
    """group, matched, missing, added, precision, recall, equivalent of two extractions, counting repeated items; ``new`` is scored against ``old``."""
    one = lambda d, a, b: d.select(group, *item, F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    n = one(old, 1, 0).unionByName(one(new, 0, 1)).groupBy(group, *item).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = F.sum(F.least("a", "b"))
    g = n.groupBy(group).agg(both.alias("matched"), (F.sum("a") - both).alias("missing"), (F.sum("b") - both).alias("added"))
    rate = lambda other: F.round(F.col("matched") / F.nullif(F.col("matched") + F.col(other), F.lit(0)), 6)
    return g.select(group, "matched", "missing", "added", rate("added").alias("precision"), rate("missing").alias("recall"), (F.col("missing") + F.col("added") == 0).alias("equivalent"))


def stage_profile(spent: DataFrame) -> DataFrame:
    """stage, n, seconds, percent of spans (stage, seconds); a null stage is time that no stage accounts for."""
    g = spent.groupBy(F.coalesce("stage", F.lit("unattributed")).alias("stage")).agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    # a row for each stage is left, so one task takes the total
    return g.select("stage", "n", F.round("seconds", 6).alias("seconds"), F.round(100 * F.col("seconds") / F.sum("seconds").over(W.partitionBy()), 6).alias("percent"))


def parsed_answer(c: Column) -> Column:
    """What follows "answer:" on its line, else the first line; null where that is empty."""
    text = F.coalesce(c, F.lit(""))
    marked = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, r"(?i)answer:([^\n]*)", 1)), "(?i)^answer:", ""))
    return F.when(text.rlike("(?i)answer:"), marked).otherwise(F.nullif(F.trim(F.split(text, "\n")[0]), F.lit("")))


def best_answer(answers: DataFrame, key: list[str], answer: str, references: str) -> DataFrame:
    """key, exact, contained, f1: the best of the answer and its parsed form over all references (an array)."""
    forms = F.array_compact(F.array(F.col(answer), parsed_answer(F.col(answer))))
    answers = answers.withColumn("_rows", F.count("*").over(W.partitionBy(*key)))
    pairs = answers.select(*key, "_rows", F.posexplode(forms).alias("_form", "_p"), references).select(*key, "_rows", "_form", "_p", F.posexplode(references).alias("_reference", "_r"))
    scored = answer_f1(pairs, [*key, "_form", "_reference"], "_p", "_r")
    return scored.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("exact", "contained", "f1")])
