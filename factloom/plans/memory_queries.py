"""Queries over the store, spans, chunks and dependency candidates, with SQL twins where SQL can express them."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.operators import consolidation, discovery, filling, ingest, intervals, paths, relations, retrieve, selectors, spans
from factloom.plans.catalogue import query
from factloom.plans.state_queries import FS
from factloom.sources import adapters as S
from factloom.sources.durable import shared_folder, written
from factloom.sources.store import Store


@query()
def ingest_fold(spark, d):
    """What the conversations leave in a store: every state with its status, evidence and order. (A fold in order of arrival with cascades is beyond SQL; a plain fold in the tests stands for a twin.)"""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    ingest.ingest(store, S.candidates(spark, d), "conversations")
    return store.table("states").select("group_id", "state_id", "entity", "attribute", "value", "status", "uncertainty", "observation_index", "sequence_index", F.size("evidence_ids").cast("long").alias("n_evidence"), "revalidate")


#: current states: the last of each slot, in groups of users; a fifth of all events share an evidence id by fives
CURRENT = f"""{FS}, cu AS (SELECT 'g' || entity % 10 AS group_id, * FROM (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY observed_at DESC, state_id DESC) AS r FROM fs) WHERE r = 1)"""


def current_states(spark, d):
    s = S.full_states(spark, d)
    last = F.row_number().over(W.partitionBy("entity", "attribute").orderBy(F.desc("observed_at"), F.desc("state_id")))
    s = s.withColumn("_r", last).where("_r = 1").drop("_r")
    return s.withColumn("group_id", F.concat(F.lit("g"), (F.col("entity") % 10).cast("string")))


@query(f"""WITH {CURRENT}, nw AS (SELECT * FROM cu WHERE k % 7 = 1 OR attribute = 'signup'),
a AS (SELECT n.group_id, o.state_id AS prerequisite, n.state_id AS dependent, ['explicit_semantic_relation', 'used_by_relation'] AS s, 0 AS o, 'stated' AS reason FROM nw n JOIN cu o ON o.entity = n.entity AND o.attribute = 'purchase' WHERE n.attribute = 'signup'),
b AS (SELECT n.group_id, o.state_id, n.state_id, ['causal_text_grounding', 'explicit_source_relation'], 1, n.span FROM nw n JOIN cu o ON o.group_id = n.group_id AND o.state_id <> n.state_id AND list_contains(regexp_extract_all(n.span, '[\\p{{L}}\\p{{N}}_]+'), CAST(o.entity AS VARCHAR)) WHERE n.k % 7 = 1),
c AS (SELECT n.group_id, o.state_id, n.state_id, ['execution_provenance'], 2, 'shared evidence' FROM nw n JOIN cu o ON o.group_id = n.group_id AND o.state_id <> n.state_id AND o.state_id // 5 = n.state_id // 5)
SELECT group_id, prerequisite, dependent, array_to_string(list_sort(list_distinct(flatten(list(s)))), ',') AS signals, arg_min(reason, o) AS reason FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY ALL""")
def dependency_candidates(spark, d):
    """Who may depend on whom among the current states: signups rest on purchases, causal clauses name users, neighbours share evidence."""
    s = current_states(spark, d)
    text = lambda c: F.col(c).cast("string").alias(c)
    selector = F.struct(F.col("entity").cast("string").alias("entity"), F.lit("purchase").alias("attribute"), F.lit(None).cast("string").alias("value"), F.lit("depends-on").alias("relation_type"))
    none = F.array().cast("array<struct<entity:string,attribute:string,value:string,relation_type:string>>")
    s = s.select("group_id", "state_id", text("entity"), "attribute", text("value"), F.lit("CURRENT").alias("status"), "span", F.array(F.floor(F.col("state_id") / 5).cast("string")).alias("evidence_ids"), F.when(F.col("attribute") == "signup", F.array(selector)).otherwise(none).alias("depends"), "observation_index", "sequence_index", "k")
    got = discovery.candidates(s.where("k % 7 = 1 or attribute = 'signup'"), s)
    return got.select("group_id", "prerequisite", "dependent", F.array_join("signals", ",").alias("signals"), "reason")


@query()
def ranked_fill(spark, d):
    """For each nation the ten customers, orders and parts of orders that a question about its richest covers; a fill in order of choices, tested against a plain walk."""
    c, o, li = (S.read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    tag = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    mine = c.select(F.col("c_nationkey").alias("question_id"), "c_custkey", F.col("c_acctbal").alias("score"))
    people = mine.select("question_id", tag("c", "c_custkey").alias("state_id"), "score", F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1).alias("intent"))
    orders = mine.join(o, F.col("c_custkey") == F.col("o_custkey")).select("question_id", "o_orderkey", tag("o", "o_orderkey").alias("state_id"), (F.col("o_totalprice") / 1e6).alias("score"))
    lines = orders.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("question_id", F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("state_id"), (F.col("l_extendedprice") / 1e7).alias("score"))
    states = people.select("question_id", "state_id", "score").unionByName(orders.select("question_id", "state_id", "score")).unionByName(lines)
    cover = filling.coverage(people.where("score > 0").select("question_id", "state_id", "intent", F.col("score").alias("overlap")))
    place = F.struct(F.col("score").isNull().alias("a"), (-F.col("score")).alias("b"), F.col("state_id").alias("c"))
    ranked = states.withColumn("rank", place).join(cover, ["question_id", "state_id"], "left").withColumn("relevant", F.col("score") > 0).withColumn("provenance", F.lit(False))
    edges = o.select(tag("c", "o_custkey").alias("source"), tag("o", "o_orderkey").alias("target"), F.lit("depends-on").alias("relation_type")).unionByName(li.select(tag("o", "l_orderkey").alias("source"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("target"), F.lit("derived-from").alias("relation_type")))
    return filling.fill(ranked, edges)


@query(f"""WITH {FS}, s AS (SELECT *, CASE WHEN t0 = observed_at THEN NULL ELSE t0 END AS a, t1 AS b, observed_at - to_hours(3) AS c0 FROM fs), x AS (SELECT state_id, entity, attribute, value, c0 AS t0, coalesce(t1, observed_at + to_hours(12)) AS t1, cond FROM s)
SELECT n.state_id, n.entity, n.attribute FROM x n WHERE EXISTS (SELECT 1 FROM x o WHERE o.entity = n.entity AND o.attribute = n.attribute AND o.value = n.value AND o.state_id <> n.state_id AND o.t0 < n.t1 AND n.t0 < o.t1 AND (o.t0 < n.t0 OR (o.t0 = n.t0 AND (o.t1 < n.t1 OR (o.t1 = n.t1 AND o.state_id < n.state_id)))) AND len(list_filter(n.cond, lambda a: len(list_filter(o.cond, lambda b: a.key = b.key AND a.value <> b.value)) > 0)) = 0)""")
def active_slot_overlaps(spark, d):
    """States that say the same as an earlier one of their slot, at times and under conditions that meet: what must not be active twice."""
    s = S.full_states(spark, d)
    hours = lambda n: F.make_dt_interval(hours=F.lit(n))
    s = s.select("entity", "attribute", "value", F.col("state_id").alias("id"), (F.col("observed_at") - hours(3)).alias("t0"), F.coalesce("t1", F.col("observed_at") + hours(12)).alias("t1"), "cond")
    return intervals.overlapping(s, ["entity", "attribute", "value"]).select(F.col("id").alias("state_id"), "entity", "attribute")


SENTENCES = r"""sp AS (SELECT conv_id, turn, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[^.!?。！？]+[.!?。！？]*|[.!?。！？]+') AS p FROM conversations), su AS (SELECT conv_id, turn, t, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM sp),
sq AS (SELECT conv_id, turn, t, piece, i, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM su),
se AS (SELECT conv_id, turn, t, e - length(piece) AS start, e AS "end", row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS sentence FROM sq WHERE regexp_matches(regexp_replace(piece, '[.!?。！？]+$', ''), '\S'))"""


@query(f"""WITH {SENTENCES}, c AS (SELECT conv_id, turn, start + 2 AS a, "end" AS b FROM se WHERE sentence % 3 = 0 UNION ALL SELECT conv_id, turn, start, start + 40 FROM se WHERE sentence % 5 = 1), w AS (SELECT conv_id, turn, length(t) AS n FROM sp),
k AS (SELECT conv_id, turn, greatest(a, 0) AS a, least(b, n) AS b FROM c JOIN w USING (conv_id, turn)), g AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY conv_id, turn ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS o FROM k WHERE b > a),
i AS (SELECT conv_id, turn, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CAST(o AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM g) GROUP BY conv_id, turn, isl), e AS (SELECT conv_id, turn, a, b FROM i UNION ALL SELECT conv_id, turn, n, n FROM w),
r AS (SELECT conv_id, turn, coalesce(lag(b) OVER (PARTITION BY conv_id, turn ORDER BY a, b), 0) AS start, a AS "end" FROM e) SELECT conv_id, turn, start, "end" FROM r WHERE "end" > start""")
def uncovered_ranges(spark, d):
    """What the spans of candidates (every third sentence, and the head of some others) leave of each turn: the targets of a recovery pass."""
    t = S.read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    s = spans.sentences(t, ["conv_id", "turn"])
    covered = s.where("sentence % 3 = 0").select("conv_id", "turn", (F.col("start") + 2).alias("start"), "end").unionByName(s.where("sentence % 5 = 1").select("conv_id", "turn", "start", (F.col("start") + 40).alias("end")))
    return intervals.gaps(covered, t.select("conv_id", "turn", F.length("text").cast("long").alias("length")), ["conv_id", "turn"])


@query(f"""WITH {SENTENCES}, ch AS (SELECT conv_id, turn, unnest(range(0, greatest(length(t), 1), 300)) AS a, length(t) AS n FROM sp), c AS (SELECT conv_id, turn, a // 300 AS chunk_id, a AS c0, least(a + 400, n) AS c1 FROM ch),
m AS (SELECT se.conv_id, se.turn, sentence, c.chunk_id, c.c0, c.c0 <= start AND "end" <= c.c1 AS holds, least("end", c.c1) - greatest(start, c.c0) AS shared FROM se JOIN c ON c.conv_id = se.conv_id AND c.turn = se.turn AND c.c0 < "end" AND start < c.c1),
b AS (SELECT conv_id, turn, sentence, arg_min(chunk_id, (NOT holds, CASE WHEN holds THEN 0 ELSE -shared END, c0, chunk_id)) AS chunk_id, count(*) FILTER (holds) AS n_chunks FROM m GROUP BY ALL)
SELECT conv_id, turn, sentence AS range_id, chunk_id, n_chunks, CASE WHEN n_chunks = 1 THEN 'CONTAINED' WHEN n_chunks > 1 THEN 'FIRST' ELSE 'OVERLAP' END AS how FROM b""")
def fact_chunks(spark, d):
    """The chunk (400 characters every 300) that holds each sentence of a turn."""
    t = S.read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    ranges = spans.sentences(t, ["conv_id", "turn"]).withColumnRenamed("sentence", "range_id")
    n = F.length("text")
    cuts = t.select("conv_id", "turn", n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(300))).alias("chunk_start"))
    cuts = cuts.select("conv_id", "turn", F.floor(F.col("chunk_start") / 300).cast("long").alias("chunk_id"), F.col("chunk_start").cast("long").alias("chunk_start"), F.least(F.col("chunk_start") + 400, F.col("n")).alias("chunk_end"))
    return intervals.containing(ranges, cuts, ["conv_id", "turn"], 300).select("conv_id", "turn", "range_id", "chunk_id", "n_chunks", "how")


@query(f"""WITH {SENTENCES}, q AS (SELECT conv_id, turn, sentence, t, trim(t[start + 1:"end"], ' ' || chr(9) || chr(10) || chr(13)) AS q FROM se), n AS (SELECT *, len(string_split(t, q)) - 1 AS n FROM q)
SELECT conv_id, turn, sentence AS quote_id, CASE WHEN n = 1 THEN strpos(t, q) - 1 END AS start, CASE WHEN n = 1 THEN strpos(t, q) - 1 + length(q) END AS "end", n AS n_found, CASE WHEN n = 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS how FROM n""")
def quote_spans(spark, d):
    """Where each sentence of a turn stands in it, found again from its words."""
    t = S.read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    s = spans.sentences(t, ["conv_id", "turn"]).join(t, ["conv_id", "turn"])
    said = F.regexp_replace(F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return spans.located(t, s.select("conv_id", "turn", F.col("sentence").alias("quote_id"), said.alias("quote"), F.lit(None).cast("long").alias("hint")), ["conv_id", "turn"])


@query()
def boundary_chunks(spark, d):
    """Chunks of at most 1,200 characters of all documents, cut at lines, sentences or white space, sharing 120 (an ordered fold: tested against a plain one)."""
    return spans.chunks(S.read(spark, d, "documents"), ["doc_id"], 1200, 120)


@query(f"""WITH {CURRENT}, s AS (SELECT o_orderkey AS n, 'g' || o_custkey % 10 AS group_id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS e, CASE WHEN o_orderkey % 2 = 0 THEN upper(CASE WHEN o_orderstatus = 'F' THEN 'view' ELSE 'click' END) END AS a, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 4 AS VARCHAR) END AS v FROM orders),
m AS (SELECT n, count(DISTINCT state_id // 2) AS c, arg_min(state_id, (observation_index, state_id)) AS f FROM s JOIN (SELECT *, state_id AS observation_index FROM cu) cu ON cu.group_id = s.group_id AND (e IS NULL OR e = CAST(entity AS VARCHAR)) AND (a IS NULL OR lower(a) = attribute) AND (v IS NULL OR v = CAST(value AS VARCHAR)) GROUP BY n)
SELECT s.n, CASE WHEN c = 1 THEN 'ONE' WHEN c > 1 THEN 'SEVERAL' ELSE 'NONE' END AS found, coalesce(c, 0) AS n_versions, CASE WHEN c = 1 THEN f END AS state_id FROM s LEFT JOIN m ON m.n = s.n""")
def selector_hits(spark, d):
    """Which version each order's selector hits, of eight patterns of wildcards; neighbouring events are one version."""
    s = current_states(spark, d).select("group_id", "state_id", F.floor(F.col("state_id") / 2).alias("version_id"), F.col("entity").cast("string").alias("entity"), "attribute", F.col("value").cast("string").alias("value"), "observation_index", "sequence_index")
    k = F.col("o_orderkey")
    o = S.read(spark, d, "orders").select(k.alias("n"), F.concat(F.lit("g"), (F.col("o_custkey") % 10).cast("string")).alias("group_id"), F.when(k % 3 > 0, F.col("o_custkey").cast("string")).alias("sel_entity"), F.when(k % 2 == 0, F.upper(F.when(F.col("o_orderstatus") == "F", "view").otherwise("click"))).alias("sel_attribute"), F.when(k % 5 == 0, (k % 4).cast("string")).alias("sel_value"))
    return selectors.exactly_one(o, s).select("n", "found", "n_versions", "state_id")


@query(r"""WITH f AS (SELECT 'Customer ' || c_custkey AS a, 'Nation ' || c_nationkey AS b, 'residence' AS r, 'c' || c_custkey AS id, c_acctbal AS score FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT 'CUSTOMER  ' || c_custkey, 'nation ' || c_nationkey, 'residence', 'd' || c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 4 = 0 AND c_nationkey % 2 = 0 UNION ALL SELECT 'Order ' || o_orderkey, 'Customer ' || o_custkey, 'author', 'o' || o_orderkey, o_totalprice FROM orders
UNION ALL SELECT 'Customer ' || c_custkey, 'Supplier ' || c_custkey % 7, 'spouse', 'm' || c_custkey, 1.0 FROM customer), n AS (SELECT lower(trim(regexp_replace(a, '\s+', ' ', 'g'))) AS s, r AS relation, lower(b) AS o, id, score FROM f) SELECT s AS subject, relation, o AS object, min(id) AS state_id, max(score)::DOUBLE AS score, count(*) AS n_forms FROM n GROUP BY ALL""")
def canonical_facts(spark, d):
    """Facts of customers, orders and suppliers, stated directly, the other way round, in either order and as "the author of ...", each once."""
    c, o = S.read(spark, d, "customer"), S.read(spark, d, "orders")
    name = lambda p, x: F.concat(F.lit(p + " "), F.col(x).cast("string"))
    say = lambda t, e, a, v, i, s: t.select(e.alias("entity"), F.lit(a).alias("attribute"), v.alias("value"), i.alias("state_id"), s.cast("double").alias("score"))
    tag = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    facts = say(c.where("c_custkey % 3 > 0"), name("Customer", "c_custkey"), "lives in", name("Nation", "c_nationkey"), tag("c", "c_custkey"), F.col("c_acctbal"))
    facts = facts.union(say(c.where("c_custkey % 4 = 0 and c_nationkey % 2 = 0"), name("CUSTOMER ", "c_custkey"), "Residence", name("nation", "c_nationkey"), tag("d", "c_custkey"), F.col("c_acctbal") + 1))
    for m, form in enumerate(("written by", "is")):
        part = o.where(F.col("o_orderkey") % 3 == m)
        who = name("Order", "o_orderkey") if m == 0 else F.concat(F.lit("The writer of "), name("Order", "o_orderkey"))
        facts = facts.union(say(part, who, form, name("Customer", "o_custkey"), tag("o", "o_orderkey"), F.col("o_totalprice")))
    facts = facts.union(say(o.where("o_orderkey % 3 = 2"), name("Customer", "o_custkey"), "wrote", name("Order", "o_orderkey"), tag("o", "o_orderkey"), F.col("o_totalprice")))
    other = F.concat(F.lit("Supplier "), (F.col("c_custkey") % 7).cast("string"))
    facts = facts.union(say(c.where("c_custkey % 2 = 0"), name("Customer", "c_custkey"), "married to", other, tag("m", "c_custkey"), F.lit(1.0))).union(say(c.where("c_custkey % 2 = 1"), other, "husband", name("Customer", "c_custkey"), tag("m", "c_custkey"), F.lit(1.0)))
    got = relations.merged(relations.projected(facts).where("form <> 'unknown'"))
    return got.select(F.lower("subject").alias("subject"), "relation", F.lower("object").alias("object"), "state_id", "score", "n_forms")


@query()
def hub_paths(spark, d):
    """From every order, over whom it was written by and whom they are married to, to where a neighbour lives: walked both ways through hubs, all ways of four facts, which none is longer than (paths are tested against plain ones)."""
    facts = written(canonical_facts(spark, d))
    steps = relations.both_ways(facts).select("subject", F.when(F.col("reverse"), F.concat(F.lit("of_"), "relation")).otherwise(F.col("relation")).alias("relation"), "object", "state_id", "score")
    anchors = facts.where("relation = 'author'").select(F.col("subject").alias("anchor")).distinct()
    return paths.goal_paths(steps, anchors, "residence", ["author", "spouse"], max_hops=4, prune=True)


@query(f"""WITH {CURRENT}, s AS (SELECT 'u' || entity % 50 AS e, 'f' || value % 3 AS f, CAST(value // 3 AS VARCHAR) AS v, state_id AS id, observed_at AS o, CASE WHEN k % 3 <> 0 THEN observed_at + to_hours(1) END AS t0, CASE WHEN k % 4 = 0 THEN observed_at + to_hours(k + 1) ELSE observed_at + to_hours(6) END AS t1, cond, confidence FROM cu),
p AS (SELECT a.id AS x, b.id AS y FROM s a JOIN s b ON a.e = b.e AND a.f = b.f AND a.v = b.v AND a.id <> b.id AND NOT coalesce(a.t1 <= b.t0, false) AND NOT coalesce(b.t1 <= a.t0, false) AND len(list_filter(a.cond, lambda q: len(list_filter(b.cond, lambda r: q.key = r.key AND q.value <> r.value)) > 0)) = 0),
r AS (SELECT id AS node, id AS root FROM s UNION SELECT p.y, root FROM r JOIN p ON p.x = node), l AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT l.root AS candidate_id, min(e) AS entity, CASE WHEN bool_or(t0 IS NULL) THEN NULL ELSE min(t0) END AS t0, max(t1) AS t1, max(confidence) AS confidence, array_to_string(list_sort(list(id)), ',') AS evidence, count(*) AS n_merged FROM s JOIN l ON l.node = id GROUP BY l.root""".replace("WITH", "WITH RECURSIVE", 1))
def consolidated_candidates(spark, d):
    """Current states read as candidates of one observation: what says the same at times and under conditions that meet is one."""
    s = current_states(spark, d)
    hours = lambda n: F.make_dt_interval(hours=n)
    c = s.select(F.lit("g").alias("group_id"), F.lit("o").alias("observation_id"), F.col("state_id").alias("candidate_id"), F.col("state_id").alias("sequence_index"), F.concat(F.lit("u"), (F.col("entity") % 50).cast("string")).alias("entity"), F.concat(F.lit("f"), (F.col("value") % 3).cast("string")).alias("attribute"), F.floor(F.col("value") / 3).cast("string").alias("value"), F.when(F.col("k") % 3 != 0, F.col("observed_at") + hours(F.lit(1))).alias("t0"), F.when(F.col("k") % 4 == 0, F.col("observed_at") + hours((F.col("k") + 1).cast("int"))).otherwise(F.col("observed_at") + hours(F.lit(6))).alias("t1"), "cond", "confidence", "observed_at", F.array("state_id").alias("evidence_ids"))
    got = consolidation.consolidated(c)
    return got.select("candidate_id", "entity", "t0", "t1", "confidence", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("evidence"), "n_merged")


@query()
def whole_retrieval(spark, d):
    """What answers a question about views in the memory of each ten users: a store of all states, older ones of a slot STALE, with their evidence and dependencies (the parts have twins; the whole is tested on a small store)."""
    s = S.full_states(spark, d)
    newer = F.row_number().over(W.partitionBy("entity", "attribute").orderBy(F.desc("observed_at"), F.desc("state_id")))
    text = lambda c: F.col(c).cast("string").alias(c)
    key = F.col("state_id").cast("string")
    s = s.withColumn("group_id", F.concat(F.lit("g"), (F.col("entity") % 10).cast("string"))).withColumn("_n", newer)
    null = lambda name: F.lit(None).cast("string").alias(name)
    states = s.select("group_id", text("state_id"), key.alias("version_id"), F.concat_ws("-", "entity", "attribute").alias("slot_id"), text("entity"), "attribute", text("value"), F.when(F.col("_n") == 1, "CURRENT").otherwise("STALE").alias("status"), null("uncertainty"), F.lit(False).alias("revalidate"), F.lit(None).cast("timestamp_ntz").alias("t0"), F.lit(None).cast("timestamp_ntz").alias("t1"), "cond", "confidence", "observed_at", F.date_format("observed_at", "yyyy-MM-dd").alias("observation_id"), "observation_index", "sequence_index", "span", F.array(key).alias("evidence_ids"), null("duplicate_of"))
    evidence = s.select("group_id", key.alias("evidence_id"), F.date_format("observed_at", "yyyy-MM-dd").alias("observation_id"), "observed_at", F.col("span").alias("source_text"), "span")
    last = s.where("_n = 1")
    side = lambda a, name: last.where(F.col("attribute") == a).select("group_id", "entity", key.alias(name), "observed_at")
    edges = side("purchase", "source").drop("observed_at").join(side("view", "target"), ["group_id", "entity"])
    edges = edges.select("group_id", F.concat_ws("-", "source", "target").alias("relation_id"), "source", "target", F.lit("depends-on").alias("relation_type"), F.lit("STRICT").alias("strength"), F.lit("stated").alias("reason"), null("evidence_id"), F.col("observed_at").alias("created_at"))
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.commit({"states": states, "evidence": evidence, "relations": edges}, "events")
    got = retrieve.retrieve(store, "which view is seen on tuesday", dt.datetime(2024, 6, 1))
    return got.select("group_id", "place", "state_id", "entity", "attribute", "value", "status", "score", "via", "relation", F.size("evidence").alias("n_evidence"))


@query("SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS tokens FROM events")
def rolling_tokens(spark, d):
    """Tokens of the sixty seconds up to each event. Each minute is a partition that also holds the minute before it, so no task reads all events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = S.read(spark, d, "events").select("event_id", micros.alias("at"), F.floor("value").cast("long").alias("n"))
    own = F.floor(F.col("at") / 60_000_000)
    e = e.select("*", own.alias("own"), F.explode(F.array(own, own + 1)).alias("minute"))
    last = W.partitionBy("minute").orderBy("at").rangeBetween(-60_000_000, 0)
    return e.withColumn("tokens", F.sum("n").over(last)).where("minute = own").select("event_id", "tokens")
