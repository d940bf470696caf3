"""Where a walk over facts starts and what it looks for, from the words of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import identity
from factloom.operators.retrieval import FIELD_STOPWORDS

#: Words of one meaning for a relation, by the relation's name.
FAMILIES = {
    "author": "author writer written".split(),
    "spouse": "spouse spouses married partner husband wife".split(),
    "citizenship": "citizenship citizen nationality country countries nation".split(),
    "residence": "residence reside resides location live lives located home".split(),
    "ceo": "ceo chief executive".split(),
    "occupation": "occupation job role career profession past_role previous_role".split(),
}
#: Further words in a relation's label that put it into a family, and names of relations with words of their own.
LABELS = {"citizenship": ["citizens"]}
NAMES = {"employer": "employer employs works".split(), "member_of": "member membership".split()}
PERSONS = "person people".split()


def relation_words(facts: DataFrame) -> DataFrame:
    """name, word: the words that ask for a relation among the facts; one outside the families has its own words."""
    said, drop = F.split(F.lower("relation"), r"[\s_-]+"), identity.literal_set([*FIELD_STOPWORDS, *PERSONS])
    own = F.array_distinct(F.filter(said, lambda w: w.rlike(f"^{identity.WORDS}$") & ~F.array_contains(drop, w)))
    r = facts.where("relation is not null").select("relation").distinct().select(own.alias("own")).where(F.size("own") > 0)
    among = lambda ws: F.arrays_overlap("own", identity.literal_set(ws))
    family = lambda name, words: F.struct(name.alias("name"), words.alias("words"))
    kin = [F.when(among([*ws, *LABELS.get(n, [])]), family(F.lit(n), identity.literal_set(ws))) for n, ws in FAMILIES.items()]
    name = F.coalesce(*[F.when(among(ws), F.lit(n)) for n, ws in NAMES.items()], F.array_min("own"))
    r = r.select(F.coalesce(*kin, family(name, F.col("own"))).alias("f"))
    return r.select("f.name", F.explode("f.words").alias("word")).distinct()


def hint_names(others: Column, goal_at: Column, start: Column, end: Column) -> Column:
    """Other relations in walking order: behind the anchor forwards, then before it backwards, if the goal comes first."""
    after, before = F.filter(others, lambda o: o["at"] >= end), F.filter(others, lambda o: o["at"] < start)
    return F.transform(F.when(goal_at < start, F.concat(after, F.reverse(before))).otherwise(others), lambda o: o["name"])


def plans(questions: DataFrame, facts: DataFrame, max_hops: int = 3) -> DataFrame:
    """question_id, anchor, goal, hints, hops of every question.

    questions: question_id, text. facts: subject, relation. The anchor is the longest run of words that is a subject, the
    first of equally long ones. The goal is the residence where the question says "where" and asks for one, else the
    relation asked for first. hops is one and one for each hint, at most ``max_hops``; none without a goal. A null or
    empty text gives nulls, no hints and no hops; question_id is one row's, repeated ids are one question's words.

    Subjects meet the questions' runs of words by an equi join on the phrase, runs as long as the longest subject at most.
    """
    q = questions.select("question_id", identity.words(F.col("text")).alias("words"))
    phrases = facts.select(identity.words(F.col("subject")).alias("words")).where(F.size("words") > 0)
    longest = phrases.agg(F.max(F.size("words"))).first()[0] or 0
    subjects = phrases.select(F.array_join("words", " ").alias("phrase")).distinct()
    n = F.size("words")
    widths = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(longest)))), lambda w: w <= F.least(n, F.lit(longest)))
    runs = q.select("question_id", "words", F.explode(widths).alias("width"))
    runs = runs.select("question_id", "width", F.posexplode(F.transform(F.sequence(F.lit(0), n - F.col("width")), lambda i: F.array_join(F.slice("words", i + 1, F.col("width")), " "))).alias("start", "phrase"))
    best = F.max(F.struct("width", (-F.col("start")).alias("back"), "phrase"))
    anchors = runs.join(subjects, "phrase").groupBy("question_id").agg(best.alias("b")).select("question_id", F.col("b.phrase").alias("anchor"), (-F.col("b.back")).alias("start"), (F.col("b.width") - F.col("b.back")).alias("end"))
    asked = q.select("question_id", F.posexplode("words").alias("at", "word")).join(relation_words(facts), "word")
    asked = asked.groupBy("question_id", "name").agg(F.min("at").alias("at")).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("asked"))
    p = q.groupBy("question_id").agg(F.bool_or(F.array_contains("words", "where")).alias("where")).join(anchors, "question_id", "left").join(asked, "question_id", "left")
    home = F.filter("asked", lambda o: o["name"] == "residence")
    p = p.withColumn("aim", F.when(F.col("where") & (F.size(home) > 0), F.get(home, F.lit(0))).otherwise(F.get("asked", F.lit(0))))
    others = F.filter("asked", lambda o: o["name"] != F.col("aim")["name"])
    hints = F.coalesce(hint_names(others, F.col("aim")["at"], F.col("start"), F.col("end")), F.array().cast("array<string>"))
    p = p.select("question_id", "anchor", F.col("aim")["name"].alias("goal"), hints.alias("hints"))
    return p.withColumn("hops", F.when(F.col("goal").isNotNull(), F.least(F.lit(max_hops), 1 + F.size("hints"))).otherwise(0).cast("long"))
