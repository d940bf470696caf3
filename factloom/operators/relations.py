"""Facts in one canonical form: inverse relations turned round, symmetric ones in one order, equal facts merged before anything walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import identity

#: Recognised relations, the canonical name and how the two ends lie (direct, inverse, symmetric).
RELATIONS = {
    "author": ("author", "direct"),
    "authored_by": ("author", "direct"),
    "written_by": ("author", "direct"),
    "writer": ("author", "direct"),
    "author_of": ("author", "inverse"),
    "writer_of": ("author", "inverse"),
    "wrote": ("author", "inverse"),
    "spouse": ("spouse", "symmetric"),
    "spouse_of": ("spouse", "symmetric"),
    "is_spouse_of": ("spouse", "symmetric"),
    "married_to": ("spouse", "symmetric"),
    "is_married_to": ("spouse", "symmetric"),
    "partner": ("spouse", "symmetric"),
    "husband": ("spouse", "symmetric"),
    "wife": ("spouse", "symmetric"),
    "citizenship": ("citizenship", "direct"),
    "citizen_of": ("citizenship", "direct"),
    "nationality": ("citizenship", "direct"),
    "country_of_citizenship": ("citizenship", "direct"),
    "employer": ("employer", "direct"),
    "works_for": ("employer", "direct"),
    "employed_by": ("employer", "direct"),
    "employed_at": ("employer", "direct"),
    "employs": ("employer", "inverse"),
    "has_employee": ("employer", "inverse"),
    "residence": ("residence", "direct"),
    "resides_in": ("residence", "direct"),
    "lives_in": ("residence", "direct"),
    "located_in": ("location", "direct"),
    "location": ("location", "direct"),
    "ceo": ("ceo", "direct"),
    "chief_executive_officer": ("ceo", "direct"),
    "ceo_of": ("ceo", "inverse"),
    "member_of": ("member_of", "direct"),
    "has_member": ("member_of", "inverse"),
}
#: Attributes that only say "is", and the form of a subject that names a relation.
COPULAR = "am are be is was were".split()
RELATIONAL_SUBJECT = r"(?i)^\s*(?:the|a|an)\s+(.+?)\s+of\s+(.+?)\s*$"


def _lookup(which: int) -> Column:
    return F.create_map(*[F.lit(x) for name, spec in RELATIONS.items() for x in (name, spec[which])])


def projected(states: DataFrame) -> DataFrame:
    """states (entity, attribute, value) with subject, relation, object and form.

    form: direct, inverse (ends swapped), symmetric (ends in order of their lower case), unknown (an attribute that is
    no recognised relation, or no text as value). "the author of X" as an entity, with "is" or a name of the same
    relation as its attribute, states X's author (relational).
    """
    trim = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    entity, value, field = trim(F.col("entity")), trim(F.col("value")), identity.field_id(F.col("attribute"))
    inner, about = F.regexp_extract("entity", RELATIONAL_SUBJECT, 1), F.regexp_extract("entity", RELATIONAL_SUBJECT, 2)
    asked = _lookup(0)[identity.field_id(inner)]
    told = field.isin(COPULAR) | F.coalesce(_lookup(0)[field] == asked, F.lit(False))
    relational = F.coalesce((inner != "") & asked.isNotNull() & told & (value != ""), F.lit(False))
    # the phrase names the object of its relation; what the value says is that object
    key = F.when(relational, asked).otherwise(field)
    subject = F.when(relational, trim(about)).otherwise(entity)
    name, lie = _lookup(0)[key], _lookup(1)[key]
    known = name.isNotNull() & F.coalesce(value != "", F.lit(False))
    first = F.struct(F.lower(subject), subject) <= F.struct(F.lower(value), value)
    turned = known & ((lie == "inverse") | ((lie == "symmetric") & ~first))
    form = F.when(~known, "unknown").when(relational, "relational").otherwise(lie)
    return states.select("*", F.when(turned, value).otherwise(subject).alias("subject"), F.when(known, name).otherwise(field).alias("relation"), F.when(turned, subject).otherwise(F.when(known, value).otherwise(F.col("value"))).alias("object"), form.alias("form"))


def merged(facts: DataFrame) -> DataFrame:
    """subject, relation, object, state_id, score, n_forms, forms of canonical facts, equal ones (in lower case) merged.

    facts: subject, relation, object, state_id, score, form. The names are those of the least state_id, the score is the
    greatest; ``forms`` are the ways in which the fact is stated.
    """
    key = [F.lower("subject").alias("_s"), "relation", F.lower("object").alias("_o")]
    first = lambda c: F.min_by(c, "state_id").alias(c)
    g = facts.groupBy(*key).agg(first("subject"), first("object"), F.max("score").alias("score"), F.count("*").alias("n_forms"), F.array_sort(F.collect_set("form")).alias("forms"), F.min("state_id").alias("state_id"))
    return g.select("subject", "relation", "object", "state_id", "score", "n_forms", "forms")


def both_ways(facts: DataFrame) -> DataFrame:
    """Merged facts (subject, relation, object, state_id, score) as steps of a walk, also from object to subject; ``reverse`` tells which."""
    steps = facts.select(F.lower("subject").alias("subject"), "relation", F.lower("object").alias("object"), "state_id", "score")
    back = steps.select(F.col("object").alias("subject"), "relation", F.col("subject").alias("object"), "state_id", "score")
    return steps.withColumn("reverse", F.lit(False)).unionByName(back.where("subject <> object").withColumn("reverse", F.lit(True)))


def anchors_of(phrases: DataFrame) -> DataFrame:
    """phrases (id, phrase) with anchor and relation: "the author of X" anchors at X and asks for its author; other phrases at themselves."""
    inner, about = F.regexp_extract("phrase", RELATIONAL_SUBJECT, 1), F.regexp_extract("phrase", RELATIONAL_SUBJECT, 2)
    asked = _lookup(0)[identity.field_id(inner)]
    return phrases.select("*", identity.norm(F.when(asked.isNotNull(), about).otherwise(F.col("phrase"))).alias("anchor"), asked.alias("relation"))
