"""Queries over the lifecycle, linking, dependency, retrieval and evaluation operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import evidence, identity, scope
from factloom.operators import conflict, dependency, evaluation, graph, lifecycle, linking, retrieval, writer
from factloom.plans.catalogue import RUNS, SENT, TOK, query
from factloom.sources import adapters as S
from factloom.sources import snapshot

FS = """k0 AS (SELECT event_id AS state_id, user_id AS entity, event_type AS attribute, CAST(floor(value/100) AS BIGINT) AS value, CAST(props->>'k' AS BIGINT) AS k, ts AS observed_at FROM events),
fs AS (SELECT *, CASE WHEN k % 3 <> 0 THEN observed_at END AS t0, CASE WHEN k % 4 = 0 THEN observed_at + to_hours(k + 1) END AS t1,
CASE WHEN k % 10 = 0 THEN [{'key': 'mode', 'value': CAST(k % 2 AS VARCHAR)}, {'key': 'zone', 'value': 'a'}] WHEN k % 5 = 0 THEN [{'key': 'mode', 'value': CAST(k % 2 AS VARCHAR)}] ELSE [] END AS cond, (k % 10) / 10.0::DOUBLE AS confidence,
CASE k % 7 WHEN 0 THEN entity || ' ' || attribute || ' is no longer valid on monday' WHEN 1 THEN 'because of monday 10:30 ' || entity || ' ' || attribute || ' moved' WHEN 2 THEN 'separate note about ' || attribute ELSE entity || ' ' || attribute || ' is seen on tuesday 10:30' END AS span FROM k0)"""
SCOPES = """NOT coalesce(n.t1 <= o.t0, false) AND NOT coalesce(o.t1 <= n.t0, false) AS time_meets, len(list_filter(n.cond, lambda x: len(list_filter(o.cond, lambda y: x.key = y.key AND x.value <> y.value)) > 0)) = 0 AS cond_meets,
len(n.cond) > len(o.cond) AND list_has_all(n.cond, o.cond) AS narrower_cond, (o.t0 IS NULL OR coalesce(o.t0 <= n.t0, false)) AND (o.t1 IS NULL OR coalesce(o.t1 >= n.t1, false)) AS inside"""
PAIRS = f"""{FS}, id AS (SELECT state_id AS n_id, lag(state_id) OVER s AS o_id, true AS own FROM fs WINDOW s AS (PARTITION BY entity, attribute ORDER BY state_id) UNION ALL SELECT state_id, lag(state_id, 2) OVER s, true FROM fs WINDOW s AS (PARTITION BY entity, attribute ORDER BY state_id) UNION ALL SELECT state_id, lag(state_id) OVER s, false FROM fs WINDOW s AS (PARTITION BY entity ORDER BY state_id)),
pid AS (SELECT n_id, o_id, bool_or(own) AS own FROM id WHERE o_id IS NOT NULL GROUP BY ALL),
pr AS (SELECT n.state_id AS n_state_id, o.state_id AS o_state_id, n.attribute AS n_attribute, o.attribute AS o_attribute, n.value AS n_value, o.value AS o_value, n.k AS n_k, n.confidence AS n_confidence, o.confidence AS o_confidence, n.t0 AS n_t0, n.t1 AS n_t1, o.t0 AS o_t0, o.t1 AS o_t1, n.observed_at AS n_observed_at, own AND n.k % 2 = 0 AS linked, {SCOPES},
n.cond = o.cond AS one_cond, (n.t0 IS NULL OR n.t0 = n.observed_at) AND (o.t0 IS NULL OR o.t0 = o.observed_at) AND n.t1 IS NOT DISTINCT FROM o.t1 AS one_time, contains(n.span, 'no longer') <> contains(o.span, 'no longer') AS flipped FROM pid JOIN fs n ON n.state_id = n_id JOIN fs o ON o.state_id = o_id),
cl AS (SELECT *, CASE WHEN n_k % 11 = 0 OR (n_attribute = 'signup' AND o_attribute = 'error') THEN 'IMPLICIT_INVALIDATION'
WHEN NOT linked AND NOT time_meets THEN 'CONSISTENT' WHEN NOT linked AND NOT cond_meets THEN 'CONSISTENT' WHEN NOT slot AND n_k % 13 <> 0 THEN 'CONSISTENT'
WHEN slot AND n_value = o_value AND ((one_cond AND one_time) OR (one_cond AND n_t1 IS NULL AND o_t1 IS NULL)) THEN 'DUPLICATE' WHEN slot AND n_value = o_value THEN 'CONSISTENT' WHEN slot AND flipped THEN 'POLARITY'
WHEN slot AND (narrower_cond OR (inside AND (n_t0 IS DISTINCT FROM o_t0 OR n_t1 IS DISTINCT FROM o_t1) AND n_t1 IS NOT NULL AND (o_t1 IS NULL OR n_t1 < o_t1))) THEN 'TEMPORARY_EXCEPTION' WHEN n_state_id > o_state_id THEN 'UPDATE' ELSE 'UNCERTAIN' END AS c0
FROM (SELECT *, linked OR (n_attribute = o_attribute AND one_cond AND one_time) AS slot FROM pr)),
dc AS (SELECT *, CASE WHEN c0 = 'POLARITY' THEN 'EXPLICIT_CONFLICT' ELSE c0 END AS conflict, CAST(CASE WHEN c0 IN ('CONSISTENT', 'DUPLICATE') THEN 1.0 WHEN c0 = 'POLARITY' THEN least(n_confidence, o_confidence) ELSE n_confidence END AS DOUBLE) AS conflict_confidence FROM cl)"""


@query(f"WITH {FS}, p AS (SELECT n.*, lag(state_id) OVER (PARTITION BY entity, attribute ORDER BY state_id) AS o_id FROM fs n) SELECT n.state_id AS new_id, o.state_id AS old_id, {SCOPES}, (n.t0 IS NULL OR n.t0 <= o.observed_at) AND (n.t1 IS NULL OR o.observed_at < n.t1) AS effective_then FROM p n JOIN fs o ON o.state_id = n.o_id")
def condition_overlap(spark, d):
    """Interval and condition predicates of each state and the one before it in its slot."""
    s = S.full_states(spark, d)
    o = F.lag(F.struct("state_id", "t0", "t1", "cond", "observed_at")).over(W.partitionBy("entity", "attribute").orderBy("state_id"))
    p = s.withColumn("o", o).where("o is not null")
    a, b = (F.col("t0"), F.col("t1")), (F.col("o.t0"), F.col("o.t1"))
    return p.select(F.col("state_id").alias("new_id"), F.col("o.state_id").alias("old_id"), scope.overlaps(*a, *b).alias("time_meets"), scope.conditions_overlap(F.col("cond"), F.col("o.cond")).alias("cond_meets"), scope.more_specific(F.col("cond"), F.col("o.cond")).alias("narrower_cond"), scope.contains(*b, *a).alias("inside"), scope.effective(*a, F.col("o.observed_at")).alias("effective_then"))


@query(f"WITH {FS} SELECT entity, attribute, CASE WHEN NOT bool_or(t0 IS NULL) THEN min(t0) END AS scope_start, CASE WHEN NOT bool_or(t1 IS NULL) THEN max(t1) END AS scope_end, count(*) AS n FROM fs GROUP BY 1, 2")
def scope_union(spark, d):
    a, b = scope.union_scope(F.col("t0"), F.col("t1"))
    return S.full_states(spark, d).groupBy("entity", "attribute").agg(a.alias("scope_start"), b.alias("scope_end"), F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT n_state_id, o_state_id, conflict, conflict_confidence FROM dc")
def conflict_matrix(spark, d):
    """Every pair by the whole ordered list of conflict rules."""
    return conflict.classified(S.state_pairs(S.full_states(spark, d))).select("n_state_id", "o_state_id", "conflict", "conflict_confidence")


REVISED = f"""{PAIRS}, f AS (SELECT *, conflict IN ('UPDATE', 'IMPLICIT_INVALIDATION') OR (conflict = 'EXPLICIT_CONFLICT' AND (c0 = 'POLARITY' OR n_confidence > o_confidence)) AS falls, min(CASE WHEN conflict = 'DUPLICATE' THEN {{'a': CASE WHEN o_attribute = n_attribute THEN 0 ELSE 1 END, 'b': o_state_id}} END) OVER w AS win FROM dc WINDOW w AS (PARTITION BY n_state_id)),
g AS (SELECT *, bool_or(conflict = 'UNCERTAIN' OR (conflict = 'EXPLICIT_CONFLICT' AND NOT falls)) OVER w AS doubt, bool_or(conflict IN ('UPDATE', 'IMPLICIT_INVALIDATION')) OVER w AS ruled FROM f WINDOW w AS (PARTITION BY n_state_id))
SELECT n_state_id, o_state_id, conflict, CASE WHEN win IS NOT NULL THEN NULL WHEN conflict IN ('UPDATE', 'TEMPORARY_EXCEPTION') THEN 'updates' WHEN falls THEN 'invalidates' END AS edge,
CASE WHEN win IS NOT NULL AND conflict = 'DUPLICATE' AND o_state_id <> win.b THEN 'HISTORICAL' WHEN win IS NOT NULL THEN 'CURRENT' WHEN falls THEN 'STALE' WHEN conflict = 'CONSISTENT' AND o_t1 <= n_observed_at THEN 'HISTORICAL' ELSE 'CURRENT' END AS o_status,
CASE WHEN win IS NOT NULL THEN 'MERGED' WHEN doubt OR (n_confidence < 0.5 AND NOT ruled) THEN 'UNCERTAIN' ELSE 'CURRENT' END AS n_status, CASE WHEN win IS NOT NULL THEN NULL WHEN doubt THEN 'unresolved_conflict' WHEN n_confidence < 0.5 AND NOT ruled THEN 'low_confidence' END AS uncertainty_kind, win.b AS duplicate_of FROM g"""


@query(f"WITH {REVISED}")
def revision_fold(spark, d):
    """What each new state does to the old ones it is linked with, and what it becomes."""
    return conflict.revised(conflict.classified(S.state_pairs(S.full_states(spark, d))).withColumn("o_status", F.lit("CURRENT")))


@query(f"WITH {REVISED.rsplit('SELECT n_state_id', 1)[0]}, r AS (SELECT CASE WHEN win IS NOT NULL THEN 'MERGED' WHEN doubt OR (n_confidence < 0.5 AND NOT ruled) THEN 'UNCERTAIN' ELSE 'CURRENT' END AS n_status, conflict FROM g) SELECT n_status, conflict, count(*) AS n FROM r GROUP BY ALL")
def revision_rollup(spark, d):
    """Outcomes of revision by conflict class."""
    return revision_fold(spark, d).groupBy("n_status", "conflict").agg(F.count("*").alias("n"))


@query(f"""WITH {FS}, x AS (SELECT b.state_id, n.state_id AS by FROM fs b JOIN fs n ON b.entity = n.entity AND b.attribute = n.attribute AND b.state_id <> n.state_id AND b.value <> n.value
WHERE (len(n.cond) > len(b.cond) AND list_has_all(n.cond, b.cond) AND len(list_filter(n.cond, lambda c: NOT list_contains(['0', 'a', 'now'], c.value))) = 0) OR ((b.t0 IS NULL OR coalesce(b.t0 <= n.t0, false)) AND (b.t1 IS NULL OR coalesce(b.t1 >= n.t1, false)) AND (b.t0 IS DISTINCT FROM n.t0 OR b.t1 IS DISTINCT FROM n.t1))) SELECT state_id, min("by") AS "by" FROM x GROUP BY 1""")
def temporary_exceptions(spark, d):
    """Broad states that a narrower one overrides for a question with the words 0, a, now."""
    return conflict.suppressed(S.full_states(spark, d), ["0", "a", "now"])


DIRECT = "CASE WHEN instr(o.span, CAST(o.entity AS VARCHAR)) = 0 THEN -1.0 WHEN regexp_matches(substr(o.span, 1, instr(o.span, CAST(o.entity AS VARCHAR)) - 1), '\\b(because|while|when|if|after|before|due|since|that)\\b') THEN -2.0 WHEN instr(o.span, CAST(o.entity AS VARCHAR)) - 1 <= greatest(4, length(o.span) // 4) THEN 2.0 ELSE 0.5 END"
STOPS = str(evidence.LINK_STOPWORDS)


@query(f"""WITH {FS}, nw AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY entity ORDER BY observed_at DESC, state_id DESC) = 1), cu AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY observed_at DESC, state_id DESC) = 1),
pp AS (SELECT n.state_id AS n_state_id, o.state_id AS o_state_id, n.attribute = o.attribute AND n.cond = o.cond AND (n.t0 IS NULL OR n.t0 = n.observed_at) AND (o.t0 IS NULL OR o.t0 = o.observed_at) AND n.t1 IS NOT DISTINCT FROM o.t1 AS slot, n.attribute = o.attribute AS att, {SCOPES}, {DIRECT} AS direct, starts_with(o.span, 'separate') AS apart, contains(n.span, 'no longer') AS neg,
len(list_intersect(list_filter(list_distinct({TOK.format('n.span')}), lambda w: list_contains(['monday', 'tuesday'], w)), {TOK.format('o.span')})) + CASE WHEN contains(n.span, '10:30') AND contains(o.span, '10:30') THEN 1 ELSE 0 END AS times,
len(list_filter(list_intersect(list_distinct({TOK.format('n.span')}), list_distinct({TOK.format('o.span')})), lambda w: NOT list_contains({STOPS}, w) AND w <> CAST(n.entity AS VARCHAR))) AS words FROM nw n JOIN cu o ON n.entity = o.entity AND n.state_id <> o.state_id),
sc AS (SELECT *, slot OR (neg AND direct > 0 AND NOT apart AND times > 0) AS eligible, NOT slot AND neg AND direct > 0 AND NOT apart AND times > 0 AS crossed FROM pp),
sd AS (SELECT *, CASE WHEN eligible THEN round(2.0 + CASE WHEN crossed THEN 0.75 ELSE 0 END + CASE WHEN att THEN 1.0 ELSE 0 END + CASE WHEN time_meets THEN 0.5 ELSE 0 END + CASE WHEN cond_meets THEN 0.5 ELSE 0 END + least(1.5, 0.75 * words) + least(1.5, times) + direct - CASE WHEN apart THEN 2.0 ELSE 0 END, 6) ELSE 0.0 END AS score FROM sc),
rk AS (SELECT *, row_number() OVER w AS pool_rank, lead(score) OVER w AS nx FROM sd WINDOW w AS (PARTITION BY n_state_id ORDER BY score DESC, o_state_id))
SELECT n_state_id, o_state_id, eligible, CAST(score AS DOUBLE) AS score, pool_rank, pool_rank = 1 AND eligible AND score - coalesce(nx, score - 0.5) >= 0.5 AS decisive FROM rk WHERE pool_rank <= 8""")
def candidate_pool(spark, d):
    """The newest state of each entity against the entity's latest state of every attribute, by the whole pool score."""
    s = S.full_states(spark, d)
    cols = [c for c in s.columns]
    newest = s.groupBy("entity").agg(F.max_by(F.struct(*cols), F.struct("observed_at", "state_id")).alias("n"))
    latest = s.groupBy("entity", "attribute").agg(F.max_by(F.struct(*cols), F.struct("observed_at", "state_id")).alias("o")).select("entity", "o")
    pairs = newest.join(latest, "entity").where("n.state_id <> o.state_id")
    return linking.pool(pairs.select(*[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "no" for c in cols]))


@query("WITH a AS (SELECT o_orderkey AS state, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root FROM orders) SELECT state, root, i - 1 AS hops FROM a WHERE i > 1")
def alias_resolution(spark, d):
    """Each order stands for the customer's order before it: chains resolve to the first one."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    a = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("state"), F.lag("o_orderkey").over(w).alias("parent")).where("parent is not null")
    return linking.roots(a)


ANTI = "e AS (SELECT l_partkey % 97 AS source, l_suppkey % 97 AS target, CAST(l_linenumber % 3 AS BIGINT) AS strength, l_discount AS confidence, CAST(l_quantity AS BIGINT) AS n_signals, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 97 <> l_suppkey % 97)"


@query(f"WITH {ANTI}, r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY strength DESC, confidence DESC, n_signals DESC, source, target) AS k FROM e) SELECT source, target, strength, confidence, n_signals FROM r WHERE k = 1")
def antisymmetry(spark, d):
    """Of all assessed edges between two endpoints, in both directions, the strongest stays."""
    li = S.read(spark, d, "lineitem").select((F.col("l_partkey") % 97).alias("source"), (F.col("l_suppkey") % 97).alias("target"), (F.col("l_linenumber") % 3).cast("long").alias("strength"), F.col("l_discount").alias("confidence"), F.col("l_quantity").cast("long").alias("n_signals"))
    return dependency.antisymmetric(li.where("source <> target"))


RE = {k: getattr(evidence, k).replace("'", "''") for k in ("MARKER", "DERIVATION", "ACTION_CUE", "PRECONDITION", "ACTION_ROLE", "DECISION_ROLE", "DERIVED_ROLE")}
SPANS = f"s AS (SELECT doc_id, CAST(i AS BIGINT) AS i, lower(s[i + 1]) AS t FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, {SENT} AS s FROM documents)))"


@query(rf"WITH {SPANS} SELECT CASE WHEN NOT regexp_matches(t, '{RE['MARKER']}') THEN 'none' WHEN regexp_matches(t, '{RE['DERIVATION']}') THEN 'derived-from' WHEN regexp_matches(t, '{RE['ACTION_CUE']}') AND regexp_matches(t, '{RE['PRECONDITION']}') THEN 'affects-action' ELSE 'depends-on' END AS relation_type, CASE WHEN regexp_matches(t, '{RE['DERIVED_ROLE']}') THEN 'DERIVED_STATE' WHEN regexp_matches(t, '{RE['DECISION_ROLE']}') THEN 'DECISION' WHEN regexp_matches(t, '{RE['ACTION_ROLE']}') THEN 'ACTION_OR_PLAN' ELSE 'ORDINARY_FACT' END AS role, count(*) AS n FROM s GROUP BY ALL")
def dependency_typing(spark, d):
    """Relation types (by dependency markers) and roles of all sentences of all documents."""
    from factloom.functions import text as T

    s = S.read(spark, d, "documents").select(F.explode(T.sentences(F.coalesce("text", F.lit("")))).alias("t"))
    t = s.select(F.coalesce(evidence.relation_type(F.col("t")), F.lit("none")).alias("relation_type"), evidence.role(F.lit("x"), F.lit("y"), F.col("t")).alias("role"))
    return t.groupBy("relation_type", "role").agg(F.count("*").alias("n"))


CAND = """c AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'order depends on customer ' || o_custkey WHEN 1 THEN 'the plan requires stock' WHEN 2 THEN 'derived from customer ' || o_custkey WHEN 3 THEN 'plan to book only if customer ' || o_custkey || ' pays' ELSE 'seen with customer' END AS span, o_orderkey % 3 = 0 AS signal, 'customer ' || o_custkey AS src, CASE WHEN o_orderkey % 11 = 0 THEN 'customer ' || o_custkey ELSE 'order ' || o_orderkey END AS dst, o_orderkey % 13 = 0 AS one FROM orders)"""


@query(f"""WITH {CAND}, m AS (SELECT *, id % 5 <> 4 AS marked, id % 5 IN (0, 2, 3) AS grounded FROM c), r AS (SELECT *, CASE WHEN dst = src THEN 'same slot' WHEN NOT marked AND NOT signal THEN 'no direction' WHEN marked AND NOT grounded THEN 'source not in clause' WHEN one THEN 'same evidence' END AS reason FROM m)
SELECT id, CASE WHEN reason IS NULL THEN CASE id % 5 WHEN 2 THEN 'derived-from' WHEN 3 THEN 'affects-action' ELSE 'depends-on' END END AS relation_type, reason FROM r""")
def relation_typing(spark, d):
    """Dependency candidates between customers and orders: typed, or rejected with the first reason."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    span = F.when(key % 5 == 0, F.concat(F.lit("order depends on customer "), cust)).when(key % 5 == 1, "the plan requires stock").when(key % 5 == 2, F.concat(F.lit("derived from customer "), cust)).when(key % 5 == 3, F.concat(F.lit("plan to book only if customer "), cust, F.lit(" pays"))).otherwise("seen with customer")
    src = F.concat(F.lit("customer "), cust)
    c = S.read(spark, d, "orders").select(
        key.alias("id"), span.alias("span"), F.when(key % 3 == 0, F.array(F.lit("action_precondition"))).otherwise(F.array(F.lit("shared_evidence"))).alias("signals"),
        src.alias("src_entity"), F.lit("state").alias("src_attribute"), (key % 13).cast("string").alias("src_observation"), F.lit("one span").alias("src_span"),
        F.when(key % 11 == 0, src).otherwise(F.concat(F.lit("order "), key.cast("string"))).alias("dst_entity"), F.lit("state").alias("dst_attribute"), F.lit("0").alias("dst_observation"), F.lit("One span").alias("dst_span"),
    )
    return dependency.typed(c).select("id", "relation_type", "reason")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'STRICT' WHEN 1 THEN 'WEAK' ELSE 'NONE' END AS strength, CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'R' THEN false END AS cf, l_linestatus = 'F' AS evidence, l_discount > 0.01 AS direction FROM lineitem)
SELECT strength, coalesce(CAST(cf AS VARCHAR), 'null') AS counterfactual, coalesce(evidence AND direction AND CASE strength WHEN 'STRICT' THEN cf WHEN 'WEAK' THEN NOT cf ELSE false END, false) AS valid, count(*) AS n FROM g GROUP BY ALL""")
def guard_matrix(spark, d):
    """STRICT needs a counterfactual, WEAK explicitly none, and both all other guards."""
    k = F.col("l_linenumber") % 3
    strength = F.when(k == 0, "STRICT").when(k == 1, "WEAK").otherwise("NONE")
    cf = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    valid = dependency.semantics_valid(strength, cf, F.col("l_linestatus") == "F", F.col("l_discount") > 0.01)
    return S.read(spark, d, "lineitem").groupBy(strength.alias("strength"), F.coalesce(cf.cast("string"), F.lit("null")).alias("counterfactual"), valid.alias("valid")).agg(F.count("*").alias("n"))


PROP = """st AS (SELECT 1000000000 + c_custkey AS state_id, 1000000000 + c_custkey AS version, 'CURRENT' AS status FROM customer UNION ALL SELECT o_orderkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'HISTORICAL' WHEN o_orderstatus = 'P' THEN 'UNCERTAIN' ELSE 'CURRENT' END FROM orders
UNION ALL SELECT 2000000000 + p_partkey, 2000000000 + p_partkey - p_partkey % 2, 'CURRENT' FROM part UNION ALL SELECT 3000000000 + s_suppkey, 3000000000 + s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'CURRENT' ELSE 'STALE' END FROM supplier),
ex AS (SELECT 1000000000 + c_custkey AS source, o_orderkey AS target, 'STRICT' AS strength FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT l_orderkey, 2000000000 + l_partkey, CASE WHEN l_linenumber = 1 THEN 'STRICT' ELSE 'WEAK' END FROM lineitem UNION ALL SELECT 3000000000 + l_suppkey, l_orderkey, 'STRICT' FROM lineitem WHERE l_linenumber = 2),
ed AS (SELECT DISTINCT a.version AS source, b.version AS target, strength FROM ex JOIN st a ON a.state_id = source JOIN st b ON b.state_id = target),
su AS (SELECT ed.target AS node FROM ed JOIN st ON st.version = ed.source WHERE ed.strength = 'STRICT' AND st.status = 'CURRENT' AND ed.source >= 3000000000),
pr AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT node FROM su)),
r AS (SELECT 1000000000 + c_custkey AS node, 0 AS depth, CAST(NULL AS BIGINT) AS via, 1000000000 + c_custkey AS root FROM customer WHERE c_acctbal < 0 UNION ALL SELECT ed.target, depth + 1, ed.source, root FROM r JOIN ed ON r.node = ed.source AND ed.strength = 'STRICT' WHERE r.node NOT IN (SELECT node FROM pr)),
dn AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth, min(via) AS via, min(root) AS root, node NOT IN (SELECT node FROM pr) AS fallen FROM r GROUP BY node),
wk AS (SELECT ed.target AS node, min(depth) + 1 AS depth, min(ed.source) AS via, min(root) AS root FROM ed JOIN dn ON dn.node = ed.source AND dn.fallen WHERE ed.strength = 'WEAK' AND ed.target NOT IN (SELECT node FROM dn WHERE fallen) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {PROP} SELECT state_id, version, depth, via, root, CASE WHEN NOT fallen THEN 'PROTECTED' WHEN status NOT IN ('CURRENT', 'UNCERTAIN') THEN 'PASSED' WHEN depth = 0 THEN 'SEED' ELSE 'STALE' END AS outcome FROM dn JOIN st ON st.version = dn.node
UNION ALL SELECT state_id, version, depth, via, root, 'REVALIDATE' FROM wk JOIN st ON st.version = wk.node WHERE status IN ('CURRENT', 'UNCERTAIN')""")
def cascade_propagate(spark, d):
    """Customers in debt take their orders with them, orders their first part, in whatever of its two states; other parts are to be revalidated; urgent orders are protected where no sound supplier supports them. Finished orders pass it on without falling."""
    o, li, c, p, s = (S.read(spark, d, t) for t in ("orders", "lineitem", "customer", "part", "supplier"))
    key = lambda name, base: F.col(name) + base
    state = lambda t, i, status, version=None: t.select(i.alias("state_id"), (i if version is None else version).alias("version"), status.alias("status"))
    closed = F.when(F.col("o_orderstatus") == "F", "HISTORICAL").when(F.col("o_orderstatus") == "P", "UNCERTAIN").otherwise("CURRENT")
    states = state(c, key("c_custkey", 1_000_000_000), F.lit("CURRENT")).union(state(o, F.col("o_orderkey"), closed))
    states = states.union(state(p, key("p_partkey", 2_000_000_000), F.lit("CURRENT"), key("p_partkey", 2_000_000_000) - F.col("p_partkey") % 2))
    states = states.union(state(s, key("s_suppkey", 3_000_000_000), F.when(F.col("s_acctbal") > 5000, "CURRENT").otherwise("STALE")))
    edge = lambda t, a, b, strength: t.select(a.alias("source"), b.alias("target"), strength.alias("strength"))
    edges = edge(o, key("o_custkey", 1_000_000_000), F.col("o_orderkey"), F.lit("STRICT"))
    edges = edges.union(edge(li, F.col("l_orderkey"), key("l_partkey", 2_000_000_000), F.when(F.col("l_linenumber") == 1, "STRICT").otherwise("WEAK")))
    edges = edges.union(edge(li.where("l_linenumber = 2"), key("l_suppkey", 3_000_000_000), F.col("l_orderkey"), F.lit("STRICT")))
    return dependency.propagate(states, edges, c.where("c_acctbal < 0").select(key("c_custkey", 1_000_000_000).alias("state_id")), o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("state_id")))


@query("WITH RECURSIVE e AS (SELECT ps.c AS source, ps.s AS target FROM (SELECT DISTINCT 'n' || c_nationkey AS c, 'c' || c_custkey AS s FROM customer UNION SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0) ps), u AS (SELECT source, target FROM e UNION SELECT target, source FROM e), r AS (SELECT 'c1' AS node UNION SELECT u.target FROM r JOIN u ON r.node = u.source) SELECT node FROM r")
def subject_scope_closure(spark, d):
    """Everything that is connected with customer 1, whatever way the edges point."""
    c, s, n = (S.read(spark, d, t) for t in ("customer", "supplier", "nation"))
    tag = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    e = c.select(tag("n", "c_nationkey").alias("source"), tag("c", "c_custkey").alias("target")).union(s.select(tag("n", "s_nationkey"), tag("s", "s_suppkey"))).union(n.where("n_nationkey % 2 = 0").select(tag("r", "n_regionkey"), tag("n", "n_nationkey")))
    return graph.cascade(graph.undirected(e), c.where("c_custkey = 1").select(tag("c", "c_custkey").alias("node"))).select("node")


@query(f"""WITH {RUNS}, cu AS (SELECT entity, attribute, value FROM sv WHERE superseded_by IS NULL), ol AS (SELECT DISTINCT entity, attribute FROM sv WHERE superseded_by IS NOT NULL),
p AS (SELECT DISTINCT user_id AS entity, a AS attribute, CAST((user_id + n) % 5 AS BIGINT) AS expected FROM events, (VALUES ('purchase', 0), ('view', 2), ('refund', 1)) v(a, n)),
j AS (SELECT p.entity, p.attribute, CASE WHEN cu.value <> expected THEN 'CONFLICTED' WHEN cu.value = expected THEN 'SUPPORTED' WHEN ol.entity IS NOT NULL THEN 'CONFLICTED' ELSE 'UNVERIFIED' END AS verdict FROM p LEFT JOIN cu ON cu.entity = p.entity AND cu.attribute = p.attribute LEFT JOIN ol ON ol.entity = p.entity AND ol.attribute = p.attribute)
SELECT entity AS query_id, attribute AS premise_id, verdict, CASE WHEN bool_or(verdict = 'CONFLICTED') OVER w THEN 'REJECT_STALE_PREMISE' WHEN bool_and(verdict = 'UNVERIFIED') OVER w THEN 'CLARIFY' ELSE 'PROCEED' END AS policy FROM j WINDOW w AS (PARTITION BY entity)""")
def premise_policy(spark, d):
    """Three premises for each entity against its versions; the policy is that of the whole question."""
    v = lifecycle.slot_versions(S.states(spark, d)).select("entity", "attribute", "value", "status")
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(n).alias("n")) for a, n in (("purchase", 0), ("view", 2), ("refund", 1))])).alias("x")
    p = S.states(spark, d).select("entity").distinct().select("entity", asked).select(F.col("entity").alias("query_id"), F.col("x.attribute").alias("premise_id"), "entity", F.col("x.attribute").alias("attribute"), ((F.col("entity") + F.col("x.n")) % 5).alias("expected"))
    return retrieval.checked(p, v)


ASK = "Does Customer#000000042 still live in the building and which market segment"
_W = list(dict.fromkeys(w for w in retrieval.question_words(ASK) if w not in retrieval.SYNTAX))


@query(f"""WITH s AS (SELECT c_custkey AS state_id, c_name AS entity, CAST(c_custkey AS VARCHAR) AS evidence_id, c_mktsegment AS value, c_name = 'Customer#000000042' AS named, {TOK.format('c_name')} AS en, {TOK.format("c_name || ' market segment ' || c_mktsegment")} AS st, {TOK.format("CASE WHEN c_custkey % 2 = 0 THEN c_name || ' is in ' || c_mktsegment ELSE 'seen in ' || c_mktsegment END")} AS sp FROM customer),
a AS (SELECT *, list_filter({_W}, lambda w: NOT named OR NOT list_contains(en, w)) AS ask, list_filter(list_distinct(st), lambda w: NOT list_contains({retrieval.SYNTAX}, w) AND (NOT named OR NOT list_contains(en, w))) AS sw, list_filter(list_distinct(sp), lambda w: NOT list_contains({retrieval.SYNTAX}, w) AND (NOT named OR NOT list_contains(en, w))) AS ew FROM s),
b AS (SELECT *, CASE WHEN evidence_id IN ('7', '42') THEN 0.5 ELSE 0.0 END AS g, len(list_intersect(ask, sw)) / greatest(1, len(ask) + len(sw) - len(list_intersect(ask, sw))) AS l, len(list_intersect(ask, ew)) / greatest(1, len(ask) + len(ew) - len(list_intersect(ask, ew))) AS e, 2 / 2.0 AS f, CASE WHEN state_id % 2 = 0 AND len(list_intersect(ask, sw || ew)) > 0 THEN 0.2 ELSE 0.0 END AS d FROM a),
c AS (SELECT *, CASE WHEN named THEN 2.0 ELSE 0.0 END AS j FROM b)
SELECT state_id, CAST(round(g, 6) AS DOUBLE) AS graph_score, round(l, 6) AS lexical_score, round(e, 6) AS evidence_score, CAST(f AS DOUBLE) AS field_score, CAST(d AS DOUBLE) AS direct_score, CAST(j AS DOUBLE) AS subject_score, round(g + l + e + f + d + j, 6) AS score FROM c ORDER BY score DESC, state_id LIMIT 50""")
def retrieval_scores(spark, d):
    """The fifty best states for a question, with the parts of their scores."""
    c = S.read(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    s = c.select(F.col("c_custkey").alias("state_id"), F.col("c_name").alias("entity"), F.lit("market_segment").alias("attribute"), F.col("c_mktsegment").alias("value"), F.lit(None).cast("string").alias("description"), F.when(even, F.concat("c_name", F.lit(" is in "), "c_mktsegment")).otherwise(F.concat(F.lit("seen in "), "c_mktsegment")).alias("span"), F.col("c_custkey").cast("string").alias("evidence_id"))
    out = retrieval.scored(s, ASK, ["7", "42"]).drop("entity", "attribute", "value", "description", "span", "evidence_id")
    return out.orderBy(F.desc("score"), "state_id").limit(50)


CANDS = f"{FS}, c AS (SELECT *, entity || '/' || attribute AS slot, CAST(state_id AS VARCHAR) AS version, CASE attribute WHEN 'view' THEN 'UNKNOWN' WHEN 'click' THEN 'SET_VALUED' ELSE 'FUNCTIONAL' END AS cardinality, k % 6 <> 0 AS positive, k % 5 <> 0 AS plain, k % 4 <> 0 AS supported, k % 17 = 0 AS ended FROM fs), i AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY observed_at, version) AS i FROM c)"


@query(f"""WITH RECURSIVE {CANDS}, z AS (SELECT *, CASE WHEN positive AND plain AND NOT supported THEN 1 ELSE 0 END AS dummy FROM i),
r AS (SELECT slot, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS cv, CAST(NULL AS BIGINT) AS cx, CAST(NULL AS BOOLEAN) AS cp, CAST(NULL AS TIMESTAMP) AS ca, CAST('' AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS target, CAST('' AS VARCHAR) AS version FROM (SELECT DISTINCT slot FROM i)
UNION ALL SELECT slot, i, CASE WHEN o = 'MERGE' THEN cv WHEN ended THEN CASE WHEN t IS NOT NULL THEN NULL ELSE cv END WHEN o = 'UNCERTAIN' THEN cv ELSE version END, CASE WHEN o = 'MERGE' THEN cx WHEN ended THEN CASE WHEN t IS NOT NULL THEN NULL ELSE cx END WHEN o = 'UNCERTAIN' THEN cx ELSE value END, CASE WHEN o = 'MERGE' THEN cp WHEN ended THEN CASE WHEN t IS NOT NULL THEN NULL ELSE cp END WHEN o = 'UNCERTAIN' THEN cp ELSE positive END, CASE WHEN o = 'MERGE' THEN ca WHEN ended THEN CASE WHEN t IS NOT NULL THEN NULL ELSE ca END WHEN o = 'UNCERTAIN' THEN ca ELSE observed_at END, CASE WHEN o <> 'MERGE' AND ended THEN 'HISTORICAL' ELSE o END, CASE WHEN o = 'MERGE' THEN cv ELSE t END, version
FROM (SELECT *, CASE WHEN o IN ('REPLACE', 'REMOVE') THEN cv END AS t FROM (SELECT x.*, r.cv, r.cx, r.cp, r.ca, CASE WHEN x.positive AND x.plain AND r.cv IS NOT NULL AND r.cx = x.value AND r.cp = x.positive AND x.supported THEN 'MERGE' WHEN r.cv IS NULL AND x.positive AND x.plain THEN 'CREATE'
WHEN r.cv IS NOT NULL THEN CASE WHEN cardinality <> 'UNKNOWN' AND x.plain AND NOT (r.cx = x.value AND r.cp = x.positive) AND (x.positive OR (r.cp AND x.value = r.cx)) AND x.observed_at > r.ca AND x.supported THEN CASE WHEN x.positive THEN 'REPLACE' ELSE 'REMOVE' END ELSE 'UNCERTAIN' END
WHEN NOT (cardinality <> 'UNKNOWN' AND x.plain AND x.supported) THEN 'UNCERTAIN' ELSE 'CREATE' END AS o FROM r JOIN i x ON x.slot = r.slot AND x.i = r.i + 1)))
SELECT version, outcome, target FROM r WHERE i > 0""")
def strict_writer(spark, d):
    """Candidates of every slot through the strict writer, in order."""
    k = F.col("k")
    kind = F.when(F.col("attribute") == "view", "UNKNOWN").when(F.col("attribute") == "click", "SET_VALUED").otherwise("FUNCTIONAL")
    c = S.full_states(spark, d).select(F.concat_ws("/", F.col("entity").cast("string"), "attribute").alias("slot"), F.col("state_id").cast("string").alias("version"), "value", (k % 6 != 0).alias("positive"), kind.alias("cardinality"), (k % 5 != 0).alias("plain"), (k % 4 != 0).alias("supported"), F.col("observation_index").alias("observation"), F.col("observed_at").alias("at"), (k % 17 == 0).alias("ended"))
    return writer.strict(c).select("version", "outcome", "target")


@query(f"""WITH RECURSIVE {FS}, i AS (SELECT *, entity || '/' || attribute AS slot, attribute = 'click' AS member, CASE k % 6 WHEN 0 THEN 'REPLACE' WHEN 1 THEN 'ADD' WHEN 2 THEN 'REMOVE' WHEN 3 THEN 'UNKNOWN' ELSE 'ASSERT' END AS op, k % 5 <> 0 AS positive, 0.4 + (k % 13) / 10.0 AS conf, k % 4 <> 0 AS auth, row_number() OVER (PARTITION BY entity, attribute ORDER BY state_id) AS i FROM fs),
r AS (SELECT slot, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS cx, CAST(NULL AS BOOLEAN) AS cp, false AS unsure, false AS ever, CAST('' AS VARCHAR) AS status, CAST('' AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS state_id FROM (SELECT DISTINCT slot FROM i)
UNION ALL SELECT slot, i, CASE WHEN st IN ('CREATE', 'ADD', 'REPLACE', 'REMOVE') THEN value ELSE cx END, CASE WHEN st IN ('CREATE', 'ADD', 'REPLACE') THEN positive WHEN st = 'REMOVE' THEN false ELSE cp END, unsure OR st = 'UNCERTAIN', ever OR st IN ('CREATE', 'ADD'), st, reason, state_id
FROM (SELECT *, CASE reason WHEN 'SAME_VALUE' THEN 'MERGE' WHEN 'NEW_ASSERTION' THEN 'CREATE' WHEN 'FIRST_KNOWN_POSTCONDITION' THEN 'CREATE' WHEN 'NEW_MEMBER' THEN 'ADD' WHEN 'GROUNDED_MEMBER_REMOVAL' THEN 'REMOVE' WHEN 'GROUNDED_FORWARD_CHANGE' THEN o2 ELSE 'UNCERTAIN' END AS st
FROM (SELECT *, CASE WHEN conf < 0.5 THEN 'LOW_CONFIDENCE_OR_UNKNOWN_POLARITY' WHEN unsure THEN 'AMBIGUOUS_IDENTITY' WHEN cx IS NOT NULL AND cx = value AND cp = positive AND o2 <> 'REMOVE' THEN 'SAME_VALUE' WHEN o2 = 'ASSERT' THEN CASE WHEN cx IS NULL THEN 'NEW_ASSERTION' ELSE 'ASSERT_DOES_NOT_AUTHORIZE_REPLACEMENT' END
WHEN o2 = 'ADD' THEN CASE WHEN NOT member THEN 'ADD_TO_FUNCTIONAL_SLOT' WHEN cx IS NULL THEN 'NEW_MEMBER' ELSE 'ADD_CONFLICTS_WITH_EXISTING_MEMBER' END WHEN member AND o2 = 'REMOVE' AND (cx IS NULL OR NOT cp) THEN 'REMOVE_REQUIRES_POSITIVE_MEMBER_TARGET' WHEN o2 = 'REPLACE' AND cx IS NULL AND NOT member AND NOT ever AND positive AND auth THEN 'FIRST_KNOWN_POSTCONDITION'
WHEN cx IS NULL THEN 'MISSING_OR_AMBIGUOUS_DESTRUCTIVE_TARGET' WHEN NOT auth THEN 'UNSUPPORTED_DESTRUCTIVE_HINT' WHEN o2 = 'REMOVE' AND NOT member THEN 'REMOVE_REQUIRES_MEMBER_SLOT' WHEN o2 = 'REMOVE' THEN 'GROUNDED_MEMBER_REMOVAL' ELSE 'GROUNDED_FORWARD_CHANGE' END AS reason
FROM (SELECT x.*, r.cx, r.cp, r.unsure, r.ever, CASE WHEN member AND op = 'ASSERT' AND r.cp AND NOT x.positive THEN 'REMOVE' WHEN op = 'UNKNOWN' THEN 'ASSERT' ELSE op END AS o2 FROM r JOIN i x ON x.slot = r.slot AND x.i = r.i + 1))))
SELECT state_id, status, reason FROM r WHERE i > 0""")
def frame_resolution(spark, d):
    """Proposed changes of typed frames, slot by slot, in order."""
    k = F.col("k")
    op = F.when(k % 6 == 0, "REPLACE").when(k % 6 == 1, "ADD").when(k % 6 == 2, "REMOVE").when(k % 6 == 3, "UNKNOWN").otherwise("ASSERT")
    c = S.full_states(spark, d).select("state_id", F.concat_ws("/", F.col("entity").cast("string"), "attribute").alias("slot"), op.alias("operation"), F.when(F.col("attribute") == "click", "SET_VALUED").otherwise("FUNCTIONAL").alias("cardinality"), "value", (k % 5 != 0).alias("positive"), (0.4 + (k % 13) / 10).alias("confidence"), F.col("state_id").alias("sequence"), (k % 4 != 0).alias("authorised"))
    return writer.frames(c).select("state_id", "status", "reason")


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS batch, CAST(NULL AS BIGINT) AS turn FROM conversations
UNION ALL SELECT r.conv_id, x.i, CASE WHEN r.size > 0 AND r.size + n + 2 > 300 THEN n + 2 ELSE r.size + n + 2 END, CASE WHEN r.size > 0 AND r.size + n + 2 > 300 THEN r.batch + 1 ELSE r.batch END, x.turn FROM r JOIN i x ON x.conv_id = r.conv_id AND x.i = r.i + 1) SELECT conv_id AS group_id, turn AS observation_index, batch FROM r WHERE i > 0""")
def observation_batches(spark, d):
    """Turns of a conversation in batches of at most 300 characters, in order."""
    o = S.observations(spark, d).select(F.col("group_id").alias("slot"), F.col("observation_index").alias("position"), F.length("content").cast("long").alias("length"))
    return writer.batches(o, 300).select(F.col("slot").alias("group_id"), F.col("position").alias("observation_index"), F.col("batch").cast("long").alias("batch"))


NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query(f"""WITH p AS (SELECT conv_id, turn, {NORM.format('text')} AS p, lead({NORM.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), q AS (SELECT * FROM p WHERE r IS NOT NULL),
a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM q) GROUP BY ALL), b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS w FROM q) GROUP BY ALL), t AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS tp FROM a JOIN b USING (conv_id, turn, w) GROUP BY 1, 2)
SELECT q.conv_id AS group_id, q.turn AS observation_index, CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0.0 END AS exact, CASE WHEN contains(array_to_string(p, ' '), array_to_string(r, ' ')) THEN 1.0::DOUBLE ELSE 0.0 END AS contained, CAST(round(CASE WHEN p <> r AND (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(r, ' ') IN ('yes', 'no', 'noanswer')) THEN 0 WHEN len(p) = 0 OR len(r) = 0 THEN CASE WHEN p = r THEN 1 ELSE 0 END WHEN coalesce(tp, 0) = 0 THEN 0 ELSE 2.0 * tp / (len(p) + len(r)) END, 6) AS DOUBLE) AS f1 FROM q LEFT JOIN t USING (conv_id, turn)""")
def answer_scores(spark, d):
    """Each turn as an answer, the next one as its reference."""
    o = S.observations(spark, d)
    nxt = o.select("group_id", "observation_index", "content", F.lead("content").over(W.partitionBy("group_id").orderBy("observation_index")).alias("reference")).where("reference is not null")
    return evaluation.answer_f1(nxt, ["group_id", "observation_index"], "content", "reference")


@query("""WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount >= 0.05), e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_tax >= 0.04), j AS (SELECT coalesce(p.l_suppkey, e.l_suppkey) AS l_suppkey, p.l_partkey IS NOT NULL AS a, e.l_partkey IS NOT NULL AS b FROM p FULL JOIN e ON p.l_suppkey = e.l_suppkey AND p.l_partkey = e.l_partkey),
g AS (SELECT l_suppkey, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (b AND NOT a) AS fn FROM j GROUP BY 1) SELECT l_suppkey, tp, fp, fn, CAST(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END, 6) AS DOUBLE) AS precision, CAST(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END, 6) AS DOUBLE) AS recall FROM g""")
def invalidation_scores(spark, d):
    """Predicted against expected parts of each supplier, as sets."""
    li = S.read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_tax")
    return evaluation.set_scores(li.where("l_discount >= 0.05"), li.where("l_tax >= 0.04"), "l_suppkey", "l_partkey")


@query("""WITH g AS (SELECT l_suppkey, avg(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity > 25 AS INT) END) AS mpa, coalesce(avg(CASE WHEN l_linestatus <> 'F' THEN CAST(l_quantity > 25 AS INT) END), 1.0) AS faa, count(*) FILTER (l_linestatus <> 'F') / count(*) AS w FROM lineitem GROUP BY 1) SELECT l_suppkey, round(mpa, 6) AS mpa, round(faa, 6) AS faa, round(w, 6) AS weight, round(greatest(0.0, mpa - w * (1 - faa)), 6) AS fama FROM g""")
def fama(spark, d):
    """Presence accuracy less weighted failures to forget, for each supplier's judgements."""
    j = S.read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_linestatus") == "F", "presence").otherwise("absence").alias("kind"), (F.col("l_quantity") > 25).cast("int").alias("correct"))
    return evaluation.fama(j, "l_suppkey")


@query(r"""SELECT p_partkey, 'part:' || sha256('{"brand":' || to_json(p_brand) || ',"key":' || p_partkey || ',"name":' || to_json(p_name) || ',"note":null}') AS version_id, trim(regexp_replace(lower(p_type), '[\s_-]+', '_', 'g'), '_') AS field_id FROM part""")
def version_ids(spark, d):
    """Content-addressed ids of parts by canonical JSON, and the field ids of their types."""
    j = identity.canonical_json(name=F.col("p_name"), brand=F.col("p_brand"), key=F.col("p_partkey"), note=F.lit(None).cast("string"))
    return S.read(spark, d, "part").select("p_partkey", identity.digest("part", j).alias("version_id"), identity.field_id(F.col("p_type")).alias("field_id"))


@query(f"""WITH a AS (SELECT p_partkey, p_type, lead(p_type) OVER (ORDER BY p_partkey) AS q FROM part), t AS (SELECT p_partkey, p_type, q, list_filter(list_distinct({TOK.format('p_type')}), lambda w: NOT list_contains({identity.ATTRIBUTE_GRAMMAR}, w)) AS x, list_filter(list_distinct({TOK.format('q')}), lambda w: NOT list_contains({identity.ATTRIBUTE_GRAMMAR}, w)) AS y FROM a WHERE q IS NOT NULL)
SELECT p_type AS a, q AS b, lower(p_type) = lower(q) OR (list_has_all(x, y) AND list_has_all(y, x)) OR (len(list_intersect(x, y)) > 0 AND (list_has_all(x, y) OR list_has_all(y, x))) AS compatible, count(*) AS n FROM t GROUP BY ALL""")
def attribute_compatibility(spark, d):
    """Types of neighbouring parts as attribute names: compatible or not."""
    p = S.read(spark, d, "part").select("p_partkey", "p_type")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("b"))
    j = p.join(nxt, "p_partkey").groupBy(F.col("p_type").alias("a"), "b").agg(F.count("*").alias("n"))
    return j.select("a", "b", identity.attributes_compatible(F.col("a"), F.col("b")).alias("compatible"), "n")


FACTS = "s AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '#', '') || chr(39) || 's segment is ' || lower(c_mktsegment) || '.' WHEN 1 THEN replace(c_name, '#', '') || ' works at ' || lower(c_mktsegment) || '.' ELSE 'nothing about ' || c_name END AS t FROM customer)"


@query(rf"WITH {FACTS} SELECT id, regexp_extract(t, '^(\w+)', 1) AS entity, CASE WHEN id % 3 = 0 THEN 'segment' ELSE 'works at' END AS attribute, regexp_extract(t, '( is | works at )(.+)[.]$', 2) AS value FROM s WHERE id % 3 < 2")
def rule_extract(spark, d):
    """Possessive and verb statements about customers, parsed back into entity, attribute and value."""
    own, verb = r"^(\w+)'s (\w+) is (.+)\.$", r"^(\w+) (works at|likes) (.+)\.$"
    key, name, what = F.col("c_custkey"), F.regexp_replace("c_name", "#", ""), F.lower("c_mktsegment")
    t = F.when(key % 3 == 0, F.concat(name, F.lit("'s segment is "), what, F.lit("."))).when(key % 3 == 1, F.concat(name, F.lit(" works at "), what, F.lit("."))).otherwise(F.concat(F.lit("nothing about "), F.col("c_name")))
    s = S.read(spark, d, "customer").select(key.alias("id"), t.alias("t")).where(F.col("t").rlike(own) | F.col("t").rlike(verb))
    part = lambda i: F.when(F.col("t").rlike(own), F.regexp_extract("t", own, i)).otherwise(F.regexp_extract("t", verb, i))
    return s.select("id", part(1).alias("entity"), part(2).alias("attribute"), part(3).alias("value"))


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, CAST(sum(floor(value)) AS BIGINT) AS tokens, CAST(sum(floor(value)) AS BIGINT) > 400 AS over_budget FROM events GROUP BY 1")
def token_pacer(spark, d):
    """Tokens asked for in each minute, and whether they pass a budget."""
    e = S.read(spark, d, "events").groupBy(F.window("ts", "1 minute").alias("w")).agg(F.sum(F.floor("value")).cast("long").alias("tokens"))
    return e.select(F.col("w.start").alias("minute"), "tokens", (F.col("tokens") > 400).alias("over_budget"))


CODES = "CASE k % 10 WHEN 0 THEN 429 WHEN 1 THEN 408 WHEN 2 THEN 503 WHEN 3 THEN 504 WHEN 4 THEN 400 END"


@query(f"WITH e AS (SELECT event_type, CAST(props->>'k' AS BIGINT) AS k FROM events), c AS (SELECT {CODES} AS status, CASE WHEN event_type = 'error' THEN 'insufficient_quota' WHEN event_type = 'view' THEN 'invalid json' ELSE '' END AS message FROM e) SELECT CASE WHEN status = 429 THEN CASE WHEN contains(message, 'quota') THEN 'other' ELSE 'tpm_rate_limit' END WHEN status IN (408, 504) THEN 'timeout' WHEN status IN (500, 502, 503) THEN 'transport_failure' WHEN contains(message, 'invalid json') THEN 'malformed_structured_output' ELSE 'other' END AS class, count(*) AS n FROM c GROUP BY 1")
def error_taxonomy(spark, d):
    """Failures by class: rate limits, timeouts, transport, malformed output, other."""
    k = F.get_json_object("props", "$.k").cast("long") % 10
    status = F.when(k == 0, 429).when(k == 1, 408).when(k == 2, 503).when(k == 3, 504).when(k == 4, 400)
    message = F.when(F.col("event_type") == "error", "insufficient_quota").when(F.col("event_type") == "view", "invalid json").otherwise("")
    return S.read(spark, d, "events").groupBy(evaluation.error_class(status, message).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {FS} SELECT count(*) AS n_states, count(*) AS n_equal, CAST(sum(len(cond)) AS BIGINT) AS n_conditions FROM fs")
def snapshot_round_trip(spark, d):
    """States written as canonical JSON lines and read again by their schema: all are equal to what they were."""
    s = S.full_states(spark, d)
    again = snapshot.restored(snapshot.lines(s), s.schema)
    both = s.withColumn("h", F.xxhash64(*s.columns)).join(again.withColumn("g", F.xxhash64(*s.columns)).select("state_id", "g", F.size("cond").alias("c")), "state_id", "left")
    return both.agg(F.count("*").alias("n_states"), F.count_if(F.col("h") == F.col("g")).alias("n_equal"), F.sum("c").cast("long").alias("n_conditions"))


@query(f"""WITH {FS}, c AS (SELECT entity, state_id, row_number() OVER (PARTITION BY entity ORDER BY state_id) - 1 AS i FROM fs), b AS (SELECT *, min(CASE WHEN state_id % 100 = 3 THEN i END) OVER (PARTITION BY entity) AS broken FROM c)
SELECT entity, CAST(count(*) FILTER (broken IS NULL OR i < broken) AS BIGINT) - 1 AS last_committed, CASE WHEN max(broken) IS NULL THEN 'COMMITTED' ELSE 'NON_CONTIGUOUS' END AS status FROM b GROUP BY entity""")
def resume_position(spark, d):
    """Where each group's log of commits stops being contiguous."""
    w = W.partitionBy("entity").orderBy("state_id")
    log = S.full_states(spark, d).select("entity", (F.row_number().over(w) - 1).cast("long").alias("position"), "state_id")
    return snapshot.contiguous(log.select("entity", "position", (F.col("position") + F.when(F.col("state_id") % 100 == 3, 1).otherwise(0)).alias("claimed")))
