"""Assumptions in questions, checked against what is known before an answer is put together.

Many questions over many groups at once. A premise finds its states by equal keys alone (the slot it names, a word it
shares, an entity's word with an opposite or a like stem), so no question is compared with every state of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import identity
from factloom.sources.durable import cut

#: Fixed values of the premise rules (word lists in natural order; patterns as they must match).
STOPWORDS = "a an and are as at be been can could do does for from has have in is it last many of on or should some that the to up was were what when where which who why with years you your user still based few".split()
OPPOSITES = [("true yes", "false no"), ("available free", "unavailable busy"), ("active enabled", "inactive disabled"), ("open", "closed"), ("valid", "invalid")]
CLAUSES = [r"\b(?:because|since|given that|assuming that)\s+(.+?)(?:[,;]|\b(?:can|could|would|should)\b)", r"(?:因为|鉴于|假设)\s*(.+?)(?:[，,；;])"]
POSSESSIVE = r"^(.+?)(?:'s|’s)\s+([\w][\w\s_-]*?)\s+(?:is|are|was|were)\s+(.+?)\.?$"
COPULA = r"^([\w][\w -]*?)\s+(?:is|are|was|were)\s+(.+?)\.?$"
ACTION = r"\b(?:book|schedule|arrange|reserve|execute|proceed|deploy|send|cancel|reschedule|approve|submit|invite|run|start)\b"
CONTINUITY = "still remain remains continue continues yet anymore".split()
#: Words this long are alike if so many first letters agree.
STEM = 6
#: ignoring case, Unicode classes, lines end at \n only
FLAGS = "(?iUd)"

SELECTOR = "array<struct<entity:string,attribute:string,value:string>>"
KEYS = ["group_id", "query_id", "premise_id"]


def _squeezed(c: Column, strip: str = " ") -> Column:
    return F.trim(F.regexp_replace(F.btrim(c, F.lit(strip)), r"(?U)\s+", " "))


def _words(c: Column) -> Column:
    return F.array_distinct(identity.words(c))


def extract(questions: DataFrame) -> DataFrame:
    """group_id, query_id, premise_id (from 0), text, entity, attribute, expected, explicit of the premises a question states.

    questions: group_id, query_id, question (null: none). Clauses after because, since, given that and assuming that, then the
    Chinese ones; a clause "X's A is V" names slot and value, "X is ..." the entity alone, others nothing. A question
    without clauses that asks for an action is one premise of its whole text, not explicit.
    """
    q = F.coalesce("question", F.lit(""))
    said = F.concat(*[F.regexp_extract_all(q, F.lit(FLAGS + p), F.lit(1)) for p in CLAUSES])
    asked = F.when(F.size(said) > 0, said).when(q.rlike(FLAGS + ACTION), F.array(q)).otherwise(F.array().cast("array<string>"))
    p = questions.select("group_id", "query_id", (F.size(said) > 0).alias("explicit"), F.posexplode(asked).alias("premise_id", "text"))
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    p = p.withColumn("text", text)
    owned, is_ = F.col("explicit") & F.col("text").rlike(FLAGS + POSSESSIVE), F.col("explicit") & F.col("text").rlike(FLAGS + COPULA)
    part = lambda i: _squeezed(F.regexp_extract("text", FLAGS + POSSESSIVE, i), " .!?" if i == 3 else " ")
    entity = F.when(owned, part(1)).when(is_, _squeezed(F.regexp_extract("text", FLAGS + COPULA, 1)))
    return p.select("group_id", "query_id", F.col("premise_id").cast("long").alias("premise_id"), "text", entity.alias("entity"), F.when(owned, part(2)).alias("attribute"), F.when(owned, part(3)).alias("expected"), "explicit")


def _key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts])


def _slot_keys(entity: Column, attribute: Column, sets: list[str], mine: Column | None = None) -> list[Column]:
    """Keys of a slot under each pair (fields the premise names, fields the other side names): the values of what both name."""
    out = []
    for asked in ("e", "a", "ea"):
        for given in sets:
            value = lambda c, f: c if f in asked and f in given else F.lit("")  # noqa: B023, E731
            key = _key(F.lit(f"{asked}|{given}"), value(entity, "e"), value(attribute, "a"))
            out.append(F.when(mine == asked, key) if mine is not None else key)
    return out


def _named(entity: Column, attribute: Column) -> Column:
    return F.concat(F.when(entity.isNotNull(), "e").otherwise(""), F.when(attribute.isNotNull(), "a").otherwise(""))


def opposite_keys(words: Column, other: bool) -> Column:
    """Marks of a word set by which opposites are equal: its own (``other`` false), or those of what contradicts it."""
    sides = []
    for i, pair in enumerate(OPPOSITES):
        for j, side in enumerate(pair):
            mark = f"{i}{'+-'[1 - j if other else j]}"
            sides.append(F.when(F.arrays_overlap(words, identity.literal_set(side.split())), mark))
    if not other:
        return F.array_compact(F.concat(F.array(*sides), F.transform(words, lambda w: F.concat(F.lit("w:"), w))))
    prefixed = F.transform(words, lambda w: F.concat(F.lit("w:un"), w))
    bare = F.transform(F.filter(words, lambda w: w.startswith("un")), lambda w: F.concat(F.lit("w:"), F.substring(w, F.lit(3), F.length(w))))
    return F.array_compact(F.concat(F.array(*sides), prefixed, bare))


def _stems(words: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= STEM), lambda w: F.concat(F.lit("s:"), F.substring(w, 1, STEM))))


def _prepared_states(states: DataFrame) -> DataFrame:
    kind = F.when(F.col("status") == "CURRENT", "CURRENT").when(F.col("status") == "STALE", "STALE").when((F.col("status") == "UNCERTAIN") & (F.col("uncertainty") == "unresolved_conflict"), "UNRESOLVED")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    s = states.select("group_id", "state_id", text("entity").alias("entity"), text("attribute").alias("attribute"), text("value").alias("value"), kind.alias("kind"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("cond", F.array().cast("array<struct<key:string,value:string>>")).alias("cond"), F.coalesce(F.col("effects").cast(SELECTOR), F.array().cast(SELECTOR)).alias("effects")).where("kind is not null")
    spoken = F.concat_ws(" ", "attribute", "value", "description", F.transform("cond", lambda c: F.concat_ws(" ", c["key"], c["value"])), F.transform("effects", lambda e: F.concat_ws(" ", e["entity"], e["attribute"])))
    return s.select("*", _words(spoken).alias("said"), _words(F.col("entity")).alias("who"), _words(F.col("value")).alias("value_words"))


def _pairs(premises: DataFrame, states: DataFrame) -> DataFrame:
    """The distinct (premise, state) pairs that concern each other."""
    slots = F.concat(F.array(F.struct(identity.norm(F.col("entity")).alias("e"), identity.norm(F.col("attribute")).alias("a"))), F.transform("effects", lambda e: F.struct(identity.norm(e["entity"]).alias("e"), identity.norm(e["attribute"]).alias("a"))))
    given = states.select("group_id", "state_id", F.explode(slots).alias("t")).select("group_id", "state_id", "t.e", "t.a")
    own = _named(F.col("e"), F.col("a"))
    # a slot gives a key for each set of fields that a premise may name
    by_set = F.array(*[F.when(own == g, F.array(*_slot_keys(F.col("e"), F.col("a"), [g]))) for g in ("", "e", "a", "ea")])
    given = given.select("group_id", "state_id", F.explode(F.array_distinct(F.flatten(F.array_compact(by_set)))).alias("key"))
    structured = premises.where("named <> ''").withColumn("e", identity.norm(F.col("entity"))).withColumn("a", identity.norm(F.col("attribute")))
    keys = F.array_compact(F.array(*_slot_keys(F.col("e"), F.col("a"), ["", "e", "a", "ea"], F.col("named"))))
    wanted = structured.select(*KEYS, F.explode(keys).alias("key"))

    loose = premises.where("named = ''").withColumn("open_words", F.array_except("words", identity.literal_set(STOPWORDS)))
    tell = lambda c: F.explode(F.transform(c, lambda w: F.concat(F.lit("t:"), w)))
    wanted = wanted.unionByName(loose.select(*KEYS, tell("open_words").alias("key")))
    given = given.unionByName(states.select("group_id", "state_id", tell("said").alias("key")))

    # an entity's word alone is too little: together with an opposite of the value or a word of a like stem it counts
    sought = F.array_distinct(F.concat(opposite_keys(F.col("open_words"), True), _stems(F.col("open_words"))))
    people = states.select("group_id", F.explode("who").alias("w")).distinct()
    named = loose.select(*KEYS, sought.alias("sought"), F.explode("open_words").alias("w")).join(people, ["group_id", "w"], "left_semi")
    wanted = wanted.unionByName(named.select(*KEYS, "w", F.explode("sought").alias("x")).select(*KEYS, _key(F.col("w"), F.col("x")).alias("key")))
    held = F.array_distinct(F.concat(opposite_keys(F.col("value_words"), False), _stems(F.col("said"))))
    given = given.unionByName(states.select("group_id", "state_id", F.explode("who").alias("w"), held.alias("held")).select("group_id", "state_id", "w", F.explode("held").alias("x")).select("group_id", "state_id", _key(F.col("w"), F.col("x")).alias("key")))
    return wanted.join(given, ["group_id", "key"]).select(*KEYS, "state_id").distinct()


def _rejected(e: Column) -> Column:
    """A state's effect takes the premise's value away."""
    free = lambda a, b: a.isNull() | b.isNull() | (identity.norm(a) == identity.norm(b))
    about = free(F.col("p_entity"), e["entity"]) & free(F.col("p_attribute"), e["attribute"])
    exact = F.coalesce(identity.norm(F.col("expected")) == identity.norm(e["value"]), F.lit(False))
    # the words of the value are among those of the effect, so a shared one meets both conditions
    spoken = F.coalesce(F.arrays_overlap(identity.words(e["value"]), F.col("words")), F.lit(False))
    return about & (exact | spoken)


def findings(premises: DataFrame, states: DataFrame) -> DataFrame:
    """group_id, query_id, premise_id, state_id, entity, attribute, value, finding of each state that concerns a premise.

    premises: as of ``extract`` (or stated by the caller; entity, attribute, expected null: not named). states: group_id,
    state_id, entity, attribute, value, status, uncertainty, description, cond (key, value), effects (entity, attribute,
    value; null: any). finding: CONFLICTS, SUPPORTS or SILENT of CURRENT states, STALE, and UNRESOLVED of UNCERTAIN ones in an
    open conflict; others are left out. Premises that name a slot take its states and those with an effect on it, others
    those that share a word with attribute, value, conditions or effects, or an entity's word and an opposite or like
    stem. Rows that are repeated are one finding; null texts are empty.
    """
    p = cut(premises.select(*KEYS, F.coalesce("text", F.lit("")).alias("text"), "entity", "attribute", "expected").dropDuplicates(KEYS).select("*", _named(F.col("entity"), F.col("attribute")).alias("named"), _words(F.col("text")).alias("words")))
    s = cut(_prepared_states(states).dropDuplicates(["group_id", "state_id"]))
    pairs = _pairs(p, s)
    asked = p.select(*KEYS, F.col("entity").alias("p_entity"), F.col("attribute").alias("p_attribute"), "expected", "words")
    m = pairs.join(s, ["group_id", "state_id"]).join(asked, KEYS)
    rejected = F.exists("effects", _rejected)
    equal = identity.norm(F.col("expected")) == identity.norm(F.col("value"))
    against = F.arrays_overlap(opposite_keys(F.col("words"), True), opposite_keys(F.col("value_words"), False))
    current = (
        F.when(rejected, "CONFLICTS")
        .when(F.coalesce("expected", F.lit("")) != "", F.when(equal, "SUPPORTS").otherwise("CONFLICTS"))
        .when(F.arrays_overlap("value_words", "words"), "SUPPORTS")
        .when(against, "CONFLICTS")
        .otherwise("SILENT")
    )
    return m.select(*KEYS, "state_id", "entity", "attribute", "value", F.when(F.col("kind") == "CURRENT", current).otherwise(F.col("kind")).alias("finding"))


def verdicts(premises: DataFrame, found: DataFrame) -> DataFrame:
    """group_id, query_id, premise_id, verdict, n_supporting, n_conflicting, n_stale, n_unresolved, witness of every premise.

    CONFLICTED by a current state, else SUPPORTED by one, else CONFLICTED by stale ones, else UNVERIFIED. ``witness`` (its
    state_id, entity, attribute, value) is the least state that decides. Counts, not lists: a premise may concern any number of states,
    which ``findings`` holds.
    """
    n = lambda f: F.count_if(F.col("finding") == f)
    w = lambda f: F.min(F.when(F.col("finding") == f, F.struct("state_id", "entity", "attribute", "value")))
    counts = found.groupBy(*KEYS).agg(n("SUPPORTS").alias("n_supporting"), n("CONFLICTS").alias("n_conflicting"), n("STALE").alias("n_stale"), n("UNRESOLVED").alias("n_unresolved"), w("SUPPORTS").alias("_s"), w("CONFLICTS").alias("_c"), w("STALE").alias("_o"))
    v = premises.select(*KEYS).distinct().join(counts, KEYS, "left")
    by = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    verdict = F.when(by("n_conflicting"), "CONFLICTED").when(by("n_supporting"), "SUPPORTED").when(by("n_stale"), "CONFLICTED").otherwise("UNVERIFIED")
    witness = F.when(by("n_conflicting"), F.col("_c")).when(by("n_supporting"), F.col("_s")).otherwise(F.col("_o"))
    return v.select(*KEYS, verdict.alias("verdict"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_supporting", "n_conflicting", "n_stale", "n_unresolved")], witness.alias("witness"))


def policies(questions: DataFrame, decided: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """group_id, query_id, policy, n_premises of every question.

    REJECT_STALE_PREMISE where a premise is CONFLICTED, or where a question without premises asks whether something goes on
    and ``touched`` (group_id, query_id, state_id: stale states that the question touches) has a row of it; CLARIFY where all of one
    or more premises are UNVERIFIED; else PROCEED.
    """
    has = lambda v: F.coalesce(F.col(v), F.lit(False))
    q = questions.select("group_id", "query_id", "question").dropDuplicates(["group_id", "query_id"])
    of = decided.groupBy("group_id", "query_id").agg(F.bool_or(F.col("verdict") == "CONFLICTED").alias("bad"), F.bool_and(F.col("verdict") == "UNVERIFIED").alias("open"), F.count("*").alias("n_premises"))
    q = q.join(of, ["group_id", "query_id"], "left")
    stale = F.lit(False)
    if touched is not None:
        q = q.join(touched.select("group_id", "query_id").distinct().withColumn("touched", F.lit(True)), ["group_id", "query_id"], "left")
        stale = F.col("n_premises").isNull() & has("touched") & F.arrays_overlap(identity.words(F.col("question")), identity.literal_set(CONTINUITY))
    policy = F.when(has("bad") | stale, "REJECT_STALE_PREMISE").when(has("open"), "CLARIFY").otherwise("PROCEED")
    return q.select("group_id", "query_id", policy.alias("policy"), F.coalesce("n_premises", F.lit(0)).alias("n_premises"))


def dependencies(found: DataFrame, decided: DataFrame, relations: DataFrame) -> DataFrame:
    """group_id, query_id, state_id: what a question's relevant states rest on or carry, one step away, and isn't relevant itself.

    relations: group_id, source, target. Relevant are the findings other than SILENT; STALE ones only where they decide.
    """
    k = ["group_id", "query_id"]
    by_stale = decided.where("verdict = 'CONFLICTED' and n_conflicting = 0").select(*KEYS, F.lit(True).alias("by_stale"))
    f = found.where("finding <> 'SILENT'").join(by_stale, KEYS, "left").where("finding <> 'STALE' or by_stale")
    relevant = cut(f.select(*k, "state_id").distinct())
    ends = lambda a, b: relations.select("group_id", F.col(a).alias("state_id"), F.col(b).alias("other"))
    near = relevant.join(ends("source", "target").unionByName(ends("target", "source")), ["group_id", "state_id"])
    return near.select(*k, F.col("other").alias("state_id")).distinct().join(relevant, [*k, "state_id"], "left_anti")
