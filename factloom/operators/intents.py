"""Dependencies that an observation's own words state: "X depends on Y", each side naming exactly one known state by its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import identity
from factloom.sources.durable import cut

#: What a sentence is, and the wording of a stated dependency.
SENTENCE = r"[^.!?]+(?:[.!?]+|$)"
DEPENDS = r"(?iUd)^\s*(.+?)\s+depends\s+on\s+(.+?)\s*[.!?]*$"
SIDES = ["downstream", "prerequisite"]
#: So many first characters of a piece are looked at before it is looked up, where a group's values begin in at most so many ways.
HEAD, HEADS = 4, 256


def spoken(c: Column) -> Column:
    """The words of a text, one space between."""
    return F.array_join(identity.words(c.cast("string")), " ")


def sentences(observations: DataFrame) -> DataFrame:
    """group_id, observation_id, sentence (from 0), _s of the sentences that state a dependency."""
    s = observations.select("group_id", "observation_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE), F.lit(0))).alias("sentence", "_s"))
    return s.where(F.col("_s").rlike(DEPENDS)).withColumn("sentence", F.col("sentence").cast("long"))


def side(i: int) -> Column:
    return spoken(F.regexp_extract("_s", DEPENDS, i))


def reason() -> Column:
    return F.regexp_replace("_s", r"(?U)^\s+|\s+$", "").alias("reason")


def statements(observations: DataFrame) -> DataFrame:
    """group_id, observation_id, sentence (from 0), downstream, prerequisite, reason of the sentences that state a dependency.

    observations: group_id, observation_id, text (null: none). The first "depends on" of a sentence parts its sides.
    """
    return sentences(observations).select("group_id", "observation_id", "sentence", *[side(i + 1).alias(s) for i, s in enumerate(SIDES)], reason())


def stated(observations: DataFrame, states: DataFrame) -> DataFrame:
    """group_id, observation_id, sentence, downstream, prerequisite (state ids), reason of the dependencies that are stated without doubt.

    states: group_id, state_id, entity, attribute, value (those a sentence may name). A side names the states whose value,
    as words, stands in it (also within a word); it must be one, and the sides must not name the same slot and value. Values
    without words name nothing; rows that are repeated count once.

    Values are looked up by equal texts: of each fragment the pieces of those lengths that values of its group have,
    one row for each length, so a very long sentence costs its characters times the lengths. Pieces that begin as no value
    of their length in the group does are left out before rows are dealt (where values begin in more than ``HEADS`` ways,
    none are).
    """
    keys = ["group_id", "observation_id", "sentence"]
    said = cut(sentences(observations).dropDuplicates(keys))
    known = states.select("group_id", "state_id", identity.norm(F.col("entity").cast("string")).alias("entity"), identity.norm(F.col("attribute")).alias("attribute"), spoken(F.col("value")).alias("value")).where("value <> ''").dropDuplicates(["group_id", "state_id"])
    begins = known.select("group_id", F.length("value").alias("n"), F.substring("value", 1, HEAD).alias("h")).distinct().groupBy("group_id", "n")
    lengths = begins.agg(F.when(F.count("*") <= HEADS, F.collect_list("h")).alias("heads"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), side(i + 1).alias("fragment")) for i, s in enumerate(SIDES)])
    f = said.select(*keys, F.explode(sides).alias("x")).select(*keys, "x.side", "x.fragment").join(lengths, "group_id").where(F.length("fragment") >= F.col("n"))
    places = F.sequence(F.lit(1), F.length("fragment") - F.col("n") + 1)
    likely = F.filter(places, lambda i: F.col("heads").isNull() | F.array_contains("heads", F.substring("fragment", i, F.least(F.lit(HEAD), F.col("n")))))
    f = f.select(*keys, "side", F.explode(F.array_distinct(F.transform(likely, lambda i: F.substring("fragment", i, F.col("n"))))).alias("value"))
    own = lambda s: F.col("side") == s
    state = F.struct("state_id", "entity", "attribute", "value")
    named = f.join(known, ["group_id", "value"]).groupBy(*keys).agg(*[x for s in SIDES for x in (F.count_if(own(s)).alias(f"_n_{s}"), F.first(F.when(own(s), state), ignorenulls=True).alias(f"_{s}"))])
    slot = lambda s: F.struct(*[F.col(f"_{s}.{c}") for c in ("entity", "attribute", "value")])
    both = named.where(F.col(f"_n_{SIDES[0]}") == 1).where(F.col(f"_n_{SIDES[1]}") == 1).where(slot("downstream") != slot("prerequisite"))
    return both.join(said.select(*keys, reason()), keys).select(*keys, F.col("_downstream.state_id").alias("downstream"), F.col("_prerequisite.state_id").alias("prerequisite"), "reason")
