"""Queries over premises, guarded dependencies, answer contexts and frames, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import answers, directions, frames, intents, lifecycle, premises
from factloom.plans.catalogue import RUNS, query
from factloom.plans.memory_queries import CURRENT, current_states
from factloom.sources import adapters as S

#: what a slot's number stands for
SAID = "CASE value % 5 WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'open' WHEN 3 THEN 'closed' ELSE CAST(value AS STRING) END"


@query(f"""WITH {RUNS}, s AS (SELECT CAST(entity AS VARCHAR) AS who, attribute, first_evidence AS id, {SAID} AS v, superseded_by IS NULL AS cur, version FROM sv),
q AS (SELECT who, attribute AS a, v AS x, kind FROM s, (VALUES ('named'), ('loose')) t(kind) WHERE version = 1),
p AS (SELECT q.*, s.*, (v IN ('available', 'unavailable') AND x IN ('available', 'unavailable') AND v <> x) OR (v IN ('open', 'closed') AND x IN ('open', 'closed') AND v <> x) AS against, attribute = 'signup' AS acts FROM q JOIN s USING (who)),
m AS (SELECT who, a, kind, id, CASE WHEN NOT cur THEN 'STALE' WHEN acts AND x = 'closed' AND (kind = 'loose' OR a = 'error') THEN 'CONFLICTS' WHEN kind = 'named' THEN CASE WHEN v = x THEN 'SUPPORTS' ELSE 'CONFLICTS' END WHEN v IN (who, 'went', x) THEN 'SUPPORTS' WHEN against THEN 'CONFLICTS' ELSE 'SILENT' END AS f
FROM p WHERE CASE kind WHEN 'named' THEN attribute = a OR (acts AND a = 'error') ELSE attribute IN (who, x) OR v IN (who, 'went', x) OR against END),
c AS (SELECT who, a, kind, count(*) FILTER (f = 'SUPPORTS') AS n_supporting, count(*) FILTER (f = 'CONFLICTS') AS n_conflicting, count(*) FILTER (f = 'STALE') AS n_stale, min(id) FILTER (f = 'SUPPORTS') AS s, min(id) FILTER (f = 'CONFLICTS') AS k, min(id) FILTER (f = 'STALE') AS o FROM m GROUP BY ALL),
w AS (SELECT q.who || '-' || q.a || '-' || kind AS query_id, CASE WHEN n_conflicting > 0 THEN 'CONFLICTED' WHEN n_supporting > 0 THEN 'SUPPORTED' WHEN n_stale > 0 THEN 'CONFLICTED' ELSE 'UNVERIFIED' END AS verdict, coalesce(n_supporting, 0) AS n_supporting, coalesce(n_conflicting, 0) AS n_conflicting, coalesce(n_stale, 0) AS n_stale, CASE WHEN n_conflicting > 0 THEN k WHEN n_supporting > 0 THEN s ELSE o END AS witness FROM q LEFT JOIN c USING (who, a, kind))
SELECT *, CASE verdict WHEN 'CONFLICTED' THEN 'REJECT_STALE_PREMISE' WHEN 'UNVERIFIED' THEN 'CLARIFY' ELSE 'PROCEED' END AS policy FROM w""".replace("AS STRING)", "AS VARCHAR)"))
def premise_verdicts(spark, d):
    """Does what a question takes for granted still hold? Two questions a slot, on the first value it ever had: one names the slot, one only says a word or two; signups take closed errors away."""
    v = lifecycle.slot_versions(S.states(spark, d))
    who = F.col("entity").cast("string")
    effect = F.struct(F.lit(None).cast("string").alias("entity"), F.lit("error").alias("attribute"), F.lit("closed").alias("value"))
    s = v.select(who.alias("group_id"), F.col("first_evidence").alias("state_id"), who.alias("entity"), "attribute", F.expr(SAID).alias("value"), "status", F.lit(None).cast("string").alias("uncertainty"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("cond"), F.when(F.col("attribute") == "signup", F.array(effect)).alias("effects"), "version")
    ask = lambda kind, *words: F.struct(F.lit(kind).alias("kind"), F.concat(*words).alias("question"))
    forms = F.array(ask("named", F.lit("Since "), "entity", F.lit("'s "), "attribute", F.lit(" is "), "value", F.lit(", shall we go on?")), ask("loose", F.lit("Because "), "entity", F.lit(" went "), "value", F.lit(", shall we go on?")))
    q = s.where("version = 1").select("group_id", "entity", "attribute", F.explode(forms).alias("f")).select("group_id", F.concat_ws("-", "entity", "attribute", "f.kind").alias("query_id"), "f.question")
    stated = premises.extract(q)
    decided = premises.verdicts(stated, premises.findings(stated, s))
    return decided.join(premises.policies(q, decided), ["group_id", "query_id"]).select("query_id", "verdict", "n_supporting", "n_conflicting", "n_stale", F.col("witness.state_id").alias("witness"), "policy")


@query("""WITH i AS (SELECT conv_id AS question_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i, count(*) OVER (PARTITION BY conv_id) AS source_items FROM conversations),
b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY question_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i WHERE i <= 10),
u AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY i) AS n, substr(text, 1, CAST(600 - before AS BIGINT)) AS t FROM b WHERE text <> '' AND before < 600),
g AS (SELECT question_id, string_agg('[' || n || '] ' || t, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS used_items, CAST(sum(length(t)) AS BIGINT) AS used_characters FROM u GROUP BY 1),
h AS (SELECT question_id, min(source_items) AS source_items, sum(length(text)) > 600 OR min(source_items) > 10 AS truncated FROM b GROUP BY 1)
SELECT question_id, coalesce(context, '') AS context, source_items, coalesce(used_items, 0) AS used_items, coalesce(used_characters, 0) AS used_characters, CAST((coalesce(used_characters, 0) + 3) // 4 AS BIGINT) AS estimated_tokens, truncated FROM h LEFT JOIN g USING (question_id)""")
def answer_contexts(spark, d):
    """The latest turns of each conversation as the context of an answer: ten at most, 600 characters at most, numbered."""
    turns = S.read(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), (-F.col("turn")).alias("place"), "text")
    return answers.contexts(turns, 10, 600)


@query(f"""WITH {CURRENT}, p AS (SELECT * FROM cu WHERE attribute = 'purchase')
SELECT t.state_id AS target, p.state_id AS source, CASE WHEN t.k % 4 = 2 THEN 'unknown end' WHEN t.k % 5 IN (3, 4) THEN 'evidence supports no direction' WHEN (t.k % 3 = 0) = (t.k % 2 = 0) THEN NULL ELSE 'verdict incomplete' END AS reason
FROM cu t JOIN p USING (entity) WHERE t.attribute <> 'purchase'""")
def guarded_dependencies(spark, d):
    """Which of the verified dependencies on a user's last purchase may be kept: their evidence must name both ends in the right order, STRICT ones must have counterfactual support, WEAK ones none; a quarter names an alias that goes round."""
    s = current_states(spark, d)
    k, a = F.col("t.k"), F.col("t.attribute")
    key = F.col("state_id").cast("string")
    loop = F.concat(F.lit("loop"), key)
    base = s.select("group_id", key.alias("state_id"), F.col("entity").cast("string").alias("entity"), "attribute", F.col("value").cast("string").alias("value"), F.lit("CURRENT").alias("status"), "observed_at", F.lit(None).cast("string").alias("duplicate_of"), loop.alias("loop"))
    states = base.drop("loop").unionByName(base.select("group_id", F.col("loop").alias("state_id"), "entity", "attribute", "value", "status", "observed_at", F.col("loop").alias("duplicate_of")))
    pair = s.alias("t").where("attribute <> 'purchase'").join(s.where("attribute = 'purchase'").select("entity", F.col("state_id").alias("other")), "entity")
    told = F.when(k % 5 == 0, F.concat(a, F.lit(" because of purchase"))).when(k % 5 == 1, F.concat(a, F.lit(" requires purchase"))).when(k % 5 == 2, F.concat(F.lit("purchase affects "), a)).when(k % 5 == 3, F.concat(F.lit("purchase requires "), a)).otherwise(F.concat(F.lit("purchase and "), a))
    source = F.col("other").cast("string")
    yes = [F.lit(True).alias(c) for c in ("direction_supported", "evidence_supported", "source_grounded", "target_grounded")]
    r = pair.select("t.group_id", F.when(k % 4 == 2, F.concat(F.lit("loop"), source)).otherwise(source).alias("source"), F.col("t.state_id").cast("string").alias("target"), F.lit("depends-on").alias("relation_type"), F.when(k % 3 == 0, "STRICT").otherwise("WEAK").alias("strength"), F.array(F.lit("no more"), told).alias("spans"), (k % 2 == 0).alias("counterfactual"), *yes)
    got = directions.guarded(r, states)
    return got.select(F.col("target").cast("long").alias("target"), F.regexp_replace("source", "^loop", "").cast("long").alias("source"), "reason")


@query()
def typed_frames(spark, d):
    """What becomes of each event read as a typed frame's proposed change: views and clicks are facts, purchases roles at an organisation with facets, errors events of an instance (tested against a search of all frames)."""
    s = S.full_states(spark, d)
    k, a = F.col("k"), F.col("attribute")
    text = lambda c: F.col(c).cast("string")
    one = lambda key, value: F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    null = lambda kind: F.lit(None).cast(kind)
    kind = F.when(a == "purchase", "ROLE").when(a == "error", "EVENT").otherwise("FACT")
    facet = F.when(a == "purchase", F.when(k % 3 == 0, "status").otherwise("role")).when(a == "error", F.when(k % 2 == 0, "time").otherwise("location"))
    operation = F.element_at(F.array(*map(F.lit, ["ASSERT", "REPLACE", "ADD", "REMOVE", "PATCH", "UNKNOWN"])), (k % 6 + 1).cast("int"))
    c = s.select(
        F.concat(F.lit("g"), text("entity")).alias("group_id"), F.col("state_id").alias("candidate_id"), kind.alias("kind"), text("entity").alias("subject"), a.alias("predicate"), facet.alias("facet"), text("value").alias("value"),
        F.when(a == "purchase", one("organization", F.concat(F.lit("o"), (k % 2).cast("string")))).when(a == "error", one("instance", (k % 5).cast("string"))).alias("bindings"), null("array<struct<role:string,surface:string>>").alias("participants"),
        null("timestamp_ntz").alias("t0"), null("timestamp_ntz").alias("t1"), F.when(k % 10 == 0, F.col("cond")).alias("cond"), F.when(k % 7 == 0, "NEGATED").otherwise("POSITIVE").alias("polarity"), null("string").alias("modality"), (0.45 + F.col("confidence") / 2).alias("confidence"),
        operation.alias("operation"), null("string").alias("hint"), F.array_compact(F.array(facet)).alias("changed"), F.col("state_id").alias("sequence"), (k % 11 != 0).alias("authorised"),
    )
    rules = spark.createDataFrame([("FACT", "view", None, "SET_VALUED", []), ("FACT", "click", None, "FUNCTIONAL", []), ("FACT", "signup", None, "FUNCTIONAL", [])], "kind string, predicate string, facet string, cardinality string, keys array<string>")
    return frames.resolved(frames.identified(c, rules)).select("candidate_id", "status", "reason", "stale")


@query("""WITH c AS (SELECT c_custkey, lower(c_name) AS n, array_to_string(regexp_extract_all(lower(c_name), '[\\p{L}\\p{M}\\p{N}_]+'), ' ') AS v, c_nationkey FROM customer), s AS (SELECT o_orderkey, o_custkey, o_custkey - o_orderkey % 3 AS other FROM orders)
SELECT o_orderkey AS observation_id, d.c_custkey AS downstream, p.c_custkey AS prerequisite FROM s JOIN c d ON d.c_custkey = o_custkey JOIN c p ON p.c_custkey = other WHERE o_orderkey % 3 <> 0 AND d.c_nationkey = p.c_nationkey""")
def stated_dependencies(spark, d):
    """What every order says of its customer, "... depends on ...", read back: the names must each be one known customer of the nation that the observation belongs to."""
    c = S.read(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("group_id"))
    o = S.read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    other = S.read(spark, d, "customer").select(F.col("c_custkey").alias("other"), F.col("c_name").alias("other_name"))
    said = o.join(other, F.col("other") == F.col("o_custkey") - F.col("o_orderkey") % 3)
    obs = said.select("group_id", F.col("o_orderkey").alias("observation_id"), F.concat(F.lit("An order of "), "c_name", F.lit(" depends on that of "), "other_name", F.lit(". It is noted!")).alias("text"))
    states = c.select("group_id", F.col("c_custkey").alias("state_id"), F.col("group_id").alias("entity"), F.lit("customer").alias("attribute"), F.col("c_name").alias("value"))
    return intents.stated(obs, states).select("observation_id", "downstream", "prerequisite")
