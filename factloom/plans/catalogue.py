"""The query catalogue: DataFrame queries over the operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import text as T
from factloom.operators import graph, lifecycle, metrics
from factloom.sources import adapters as S
from factloom.streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ST = "st AS (SELECT event_id AS evidence_id, user_id AS entity, event_type AS attribute, CAST(floor(value/100) AS BIGINT) AS value, CAST(props->>'k' AS BIGINT) AS k, ts AS observed_at FROM events)"
RUNS = f"""{ST}, fl AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS opens FROM st WINDOW w AS (PARTITION BY entity, attribute ORDER BY observed_at, evidence_id)),
ru AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY entity, attribute ORDER BY observed_at, evidence_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM fl),
ve AS (SELECT entity, attribute, version, min(value) AS value, count(*) AS n_evidence, min(observed_at) AS valid_from, max(observed_at) AS last_seen, arg_min(evidence_id, observed_at) AS first_evidence, string_agg(CAST(evidence_id AS VARCHAR), '|' ORDER BY evidence_id) AS evidence FROM ru GROUP BY ALL),
sv AS (SELECT *, lead(version) OVER w AS superseded_by, lead(valid_from) OVER w AS valid_to FROM ve WINDOW w AS (PARTITION BY entity, attribute ORDER BY version))"""
TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
END = "2024-06-01 00:00:00"
QUESTION = "the current state of that thing and for whom it is the"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {RUNS} SELECT entity, attribute, version, value, n_evidence, valid_from, last_seen, first_evidence, superseded_by, valid_to, CASE WHEN superseded_by IS NULL THEN 'CURRENT' ELSE 'STALE' END AS status FROM sv")
def slot_versions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.slot_versions(S.states(spark, d))


@query(f"WITH {RUNS} SELECT entity, attribute, value, valid_from, n_evidence FROM sv WHERE superseded_by IS NULL")
def current_state(spark, d):
    return lifecycle.slot_versions(S.states(spark, d)).where("status = 'CURRENT'").select("entity", "attribute", "value", "valid_from", "n_evidence")


@query(f"WITH {RUNS} SELECT entity, attribute, version, value, valid_from, valid_to FROM sv WHERE superseded_by IS NOT NULL")
def superseded_versions(spark, d):
    return lifecycle.slot_versions(S.states(spark, d)).where("status = 'STALE'").select("entity", "attribute", "version", "value", "valid_from", "valid_to")


@query(f"WITH {RUNS} SELECT entity, attribute, superseded_by AS source_version, version AS target_version, 'updates' AS relation_type FROM sv WHERE superseded_by IS NOT NULL")
def update_edges(spark, d):
    return lifecycle.update_edges(S.states(spark, d))


@query(f"WITH {RUNS} SELECT entity, attribute, version, evidence FROM sv WHERE n_evidence > 1")
def duplicate_merge_evidence(spark, d):
    w = W.partitionBy("entity", "attribute").orderBy("observed_at", "evidence_id")
    s = S.states(spark, d).withColumn("opens", F.coalesce((F.col("value") != F.lag("value").over(w)).cast("long"), F.lit(1)))
    s = s.withColumn("version", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("evidence_id")), lambda x: x.cast("string")), "|")
    return s.groupBy("entity", "attribute", "version").agg(ids.alias("evidence"), F.count("*").alias("n")).where("n > 1").drop("n")


@query(f"""WITH {ST}, lg AS (SELECT *, lag(value) OVER (PARTITION BY entity, attribute ORDER BY observed_at, evidence_id) AS before FROM st)
SELECT attribute, before AS from_value, value AS to_value, count(*) AS n FROM lg WHERE before <> value GROUP BY ALL""")
def transition_counts(spark, d):
    w = W.partitionBy("entity", "attribute").orderBy("observed_at", "evidence_id")
    s = S.states(spark, d).withColumn("from_value", F.lag("value").over(w)).where("from_value <> value")
    return s.groupBy("attribute", "from_value", F.col("value").alias("to_value")).agg(F.count("*").alias("n"))


@query(f"""WITH {ST}, pr AS (SELECT o_orderkey AS probe_id, o_custkey AS entity, o_orderdate AS at FROM orders WHERE o_custkey IN (SELECT user_id FROM events)),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, observed_at ORDER BY evidence_id DESC) AS r FROM st) WHERE r = 1)
SELECT probe_id, pr.entity, value, evidence_id FROM pr ASOF LEFT JOIN e ON pr.entity = e.entity AND pr.at >= e.observed_at""")
def state_as_of(spark, d):
    s = S.states(spark, d)
    probes = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("at"))
    probes = probes.join(s.select("entity").distinct(), "entity", "left_semi")
    return lifecycle.as_of(s, probes)


@query(f"WITH {ST} SELECT evidence_id, entity, attribute, CASE WHEN observed_at < max(observed_at) OVER (PARTITION BY entity, attribute ORDER BY evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'UNCERTAIN' ELSE 'CURRENT' END AS status FROM st")
def late_data_uncertain(spark, d):
    return lifecycle.late_data(S.states(spark, d))


@query(f"WITH {ST} SELECT evidence_id, entity, attribute, CASE WHEN observed_at + to_minutes(k) <= TIMESTAMP '{END}' THEN 'HISTORICAL' ELSE 'CURRENT' END AS status FROM st")
def expired_to_historical(spark, d):
    return lifecycle.expired(S.states(spark, d), END)


@query(f"""WITH {ST}, s AS (SELECT *, observed_at + to_hours(24) + to_minutes(k) AS e FROM st)
SELECT a.entity, a.attribute, a.evidence_id AS old_id, b.evidence_id AS new_id FROM s a JOIN s b ON a.entity = b.entity AND a.attribute = b.attribute AND a.evidence_id < b.evidence_id AND a.value <> b.value AND a.observed_at < b.e AND b.observed_at < a.e""")
def interval_conflicts(spark, d):
    return lifecycle.interval_conflicts(S.states(spark, d))


@query(f"""WITH {ST}, c AS (SELECT *, CASE WHEN k % 2 = 0 THEN k END AS c FROM st), p AS (SELECT *, lag(value) OVER w AS pv, lag(c) OVER w AS pc, lag(observed_at) OVER w AS pt, lag(evidence_id) OVER w AS old_id FROM c WINDOW w AS (PARTITION BY entity, attribute ORDER BY evidence_id))
SELECT evidence_id, old_id, entity, attribute, CASE WHEN c <> pc THEN 'CONSISTENT' WHEN value = pv AND c IS NOT DISTINCT FROM pc THEN 'DUPLICATE' WHEN value = pv THEN 'CONSISTENT' WHEN c IS NOT NULL AND pc IS NULL THEN 'TEMPORARY_EXCEPTION' WHEN observed_at > pt THEN 'UPDATE' ELSE 'UNCERTAIN' END AS conflict FROM p WHERE old_id IS NOT NULL""")
def conflict_classes(spark, d):
    return lifecycle.classify(S.states(spark, d))


@query(f"""WITH {ST}, nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY observed_at DESC, evidence_id DESC) AS r FROM st) WHERE r = 1),
cu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY observed_at DESC, evidence_id DESC) AS r FROM st) WHERE r = 1),
sc AS (SELECT cu.entity, nw.evidence_id AS new_id, cu.evidence_id AS target_id, CAST(2.0 + CASE WHEN cu.attribute = nw.attribute THEN 1.0 ELSE 0.0 END + CASE WHEN cu.k % 2 = nw.k % 2 THEN 0.5 ELSE 0.0 END + CASE WHEN cu.observed_at >= nw.observed_at - to_days(1) THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM cu JOIN nw ON cu.entity = nw.entity AND cu.evidence_id <> nw.evidence_id),
rk AS (SELECT *, row_number() OVER w AS pool_rank, lead(score) OVER w AS ru FROM sc WINDOW w AS (PARTITION BY entity ORDER BY score DESC, target_id))
SELECT entity, new_id, target_id, score, pool_rank, pool_rank = 1 AND coalesce(score - ru, 0.5) >= 0.5 AS decisive FROM rk WHERE pool_rank <= 8""")
def link_pool_top8(spark, d):
    p = lifecycle.link_pool(S.states(spark, d))
    return p


@query(f"WITH {ST} SELECT DISTINCT sha256('default' || chr(31) || CAST(entity AS VARCHAR) || chr(31) || attribute) AS slot_id, entity, attribute FROM st")
def slot_ids(spark, d):
    return S.states(spark, d).select(T.content_id(F.lit("default"), F.col("entity"), F.col("attribute")).alias("slot_id"), "entity", "attribute").distinct()


@query("SELECT conv_id AS group_id, turn AS observation_index, sha256(CAST(conv_id AS VARCHAR) || chr(31) || CAST(turn AS VARCHAR) || chr(31) || coalesce(text, '')) AS evidence_id, CAST(length(coalesce(text, '')) AS BIGINT) AS span_end FROM conversations")
def evidence_ids(spark, d):
    return S.observations(spark, d).select("group_id", "observation_index", T.content_id(F.col("group_id"), F.col("observation_index"), F.col("content")).alias("evidence_id"), F.length("content").cast("long").alias("span_end"))


EDGES = "ed AS (SELECT 'c' || c_custkey AS source, 'o' || o_orderkey AS target FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM lineitem)"
SEEDS = "se AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0)"


def strict_edges(spark, d):
    o, li = S.read(spark, d, "orders"), S.read(spark, d, "lineitem")
    c = S.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    a = o.join(c, "o_custkey", "left_semi").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"))
    b = li.select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("target"))
    return a.unionByName(b)


def seeds(spark, d):
    return S.read(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))


@query(f"WITH RECURSIVE {EDGES}, {SEEDS}, r AS (SELECT node, 0 AS depth FROM se UNION ALL SELECT ed.target, depth + 1 FROM r JOIN ed ON r.node = ed.source) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def cascade_strict(spark, d):
    return graph.cascade(strict_edges(spark, d), seeds(spark, d))


@query(f"WITH RECURSIVE {EDGES}, {SEEDS}, r AS (SELECT node, 0 AS depth FROM se UNION ALL SELECT ed.target, depth + 1 FROM r JOIN ed ON r.node = ed.source) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (SELECT node, min(depth) AS depth FROM r GROUP BY node) GROUP BY 1")
def cascade_depth_hist(spark, d):
    return graph.cascade(strict_edges(spark, d), seeds(spark, d)).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {EDGES}, {SEEDS}, pr AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT'), oe AS (SELECT * FROM ed WHERE target NOT IN (SELECT node FROM pr)), r AS (SELECT node, 0 AS depth FROM se UNION ALL SELECT oe.target, depth + 1 FROM r JOIN oe ON r.node = oe.source) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def protected_replacement(spark, d):
    kept = S.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.protected_cascade(strict_edges(spark, d), seeds(spark, d), kept)


@query("SELECT CAST(l_suppkey AS BIGINT) AS source, count(*) AS n_flagged, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0 GROUP BY 1")
def cascade_weak_flags(spark, d):
    s = S.read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("source"))
    return S.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), "l_orderkey").join(s, "source", "left_semi").groupBy("source").agg(F.count("*").alias("n_flagged"), F.countDistinct("l_orderkey").alias("n_orders"))


CYCLE = "u AS (SELECT DISTINCT user_id AS u FROM events), n AS (SELECT count(*) AS n FROM u), ed AS (SELECT u AS source, (7 * u + 3) % n AS target FROM u, n)"


@query(f"WITH RECURSIVE {CYCLE}, r AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS depth UNION SELECT ed.target, depth + 1 FROM r JOIN ed ON r.node = ed.source WHERE depth < 400) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def cascade_cycle_safe(spark, d):
    u = S.read(spark, d, "events").select("user_id").distinct()
    e = u.join(F.broadcast(u.agg(F.count("*").alias("n")))).select(F.col("user_id").alias("source"), ((7 * F.col("user_id") + 3) % F.col("n")).alias("target"))
    return graph.cascade(e, spark.createDataFrame([(5,)], "node long"), within=400)


@query("SELECT c_name AS subject, 'resides_in' AS first, n_name AS middle, 'located_in' AS second, r_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, 'based_in', n_name, 'located_in', r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def relational_path_2hop(spark, d):
    return graph.two_hops(S.triples(spark, d))


@query(f"""WITH q AS (SELECT list_distinct(string_split('{QUESTION}', ' ')) AS q), t AS (SELECT doc_id, list_distinct({TOK.format('text')}) AS t FROM documents)
SELECT doc_id, round(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))), 9) AS score FROM t, q ORDER BY score DESC, doc_id LIMIT 10""")
def retrieval_score_topk(spark, d):
    q = F.array(*[F.lit(x) for x in dict.fromkeys(QUESTION.split())])
    docs = S.read(spark, d, "documents").select("doc_id", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("t"))
    docs = docs.select("doc_id", F.size("t").alias("n"), F.size(F.array_intersect("t", q)).alias("shared"))
    docs = docs.select("doc_id", F.round(F.col("shared") / (F.col("n") + F.size(q) - F.col("shared")), 9).alias("score"))
    return docs.orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT source, doc_id, n_chars, CAST(sum(n_chars) OVER w AS BIGINT) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) QUALIFY sum(n_chars) OVER w <= 64000")
def context_budget(spark, d):
    return windows.within_budget(S.read(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 64000)


SENT = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: length(x) > 0)"


@query(f"WITH s AS (SELECT conv_id AS group_id, turn AS observation_index, {SENT} AS s FROM conversations) SELECT group_id, observation_index, CAST(i AS BIGINT) AS sentence_index, s[i + 1] AS sentence FROM (SELECT *, unnest(range(len(s))) AS i FROM s)")
def sentence_split(spark, d):
    return S.observations(spark, d).select("group_id", "observation_index", F.posexplode(T.sentences(F.col("content"))).alias("i", "sentence")).select("group_id", "observation_index", F.col("i").cast("long").alias("sentence_index"), "sentence")


@query(f"WITH t AS (SELECT conv_id AS group_id, turn AS observation_index, list_distinct({TOK.format('text')}) AS t FROM conversations) SELECT a.group_id, a.observation_index, CAST(len(list_intersect(a.t, b.t)) AS BIGINT) AS overlap FROM t a JOIN t b ON a.group_id = b.group_id AND b.observation_index = a.observation_index + 1")
def token_overlap(spark, d):
    t = S.observations(spark, d).select("group_id", "observation_index", T.token_set(F.col("content")).alias("t"))
    n = t.select("group_id", (F.col("observation_index") - 1).alias("observation_index"), F.col("t").alias("n"))
    return t.join(n, ["group_id", "observation_index"]).select("group_id", "observation_index", F.size(F.array_intersect("t", "n")).cast("long").alias("overlap"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, sha256(substr(coalesce(text, ''), i * 800 + 1, 1000)) AS chunk_hash FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(coalesce(text, '')) - 200) / 800.0) AS BIGINT)))) AS i FROM documents)")
def chunk_windows(spark, d):
    t = F.coalesce("text", F.lit(""))
    n = F.greatest(F.lit(1), F.ceil((F.length(t) - 200) / 800.0))
    docs = S.read(spark, d, "documents").select("doc_id", t.alias("text"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("i"))
    return docs.select("doc_id", F.col("i").alias("chunk_index"), F.sha2(F.substring("text", (F.col("i") * 800 + 1).cast("int"), F.lit(1000)), 256).alias("chunk_hash"))


@query(f"WITH s AS (SELECT conv_id AS group_id, {SENT} AS s FROM conversations) SELECT group_id, round(coalesce(CAST(sum(len(list_filter(s, lambda x: regexp_matches(lower(x), '(^| )(the|is|was)( |$)')))) AS DOUBLE) / nullif(sum(len(s)), 0), 1.0), 6) AS coverage FROM s GROUP BY 1")
def coverage_ratio(spark, d):
    s = S.observations(spark, d).select("group_id", T.sentences(F.col("content")).alias("s"))
    hit = F.size(F.filter("s", lambda x: F.lower(x).rlike("(^| )(the|is|was)( |$)")))
    return s.groupBy("group_id").agg(F.round(F.coalesce(F.sum(hit) / F.nullif(F.sum(F.size("s")), F.lit(0)), F.lit(1.0)), 6).alias("coverage"))


@query(f"WITH k AS (SELECT doc_id, sha256(array_to_string(list_sort(list_distinct({TOK.format('text')})), ' ')) AS token_key FROM documents) SELECT token_key, min(doc_id) AS keeper, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1")
def semantic_dedup(spark, d):
    k = S.read(spark, d, "documents").select("doc_id", F.sha2(F.array_join(T.token_set(F.coalesce("text", F.lit(""))), " "), 256).alias("token_key"))
    return k.groupBy("token_key").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")


@query("WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS o FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f) SELECT conv_id AS group_id, segment, min(role) AS speaker, count(*) AS n_turns, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM g GROUP BY 1, 2")
def speaker_segments(spark, d):
    w = W.partitionBy("group_id").orderBy("observation_index")
    o = S.observations(spark, d).withColumn("o", F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("long"), F.lit(1)))
    o = o.withColumn("segment", F.sum("o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return o.groupBy("group_id", "segment").agg(F.min("speaker").alias("speaker"), F.count("*").alias("n_turns"), F.sum(F.length("content")).cast("long").alias("n_chars"))


@query(r"SELECT conv_id AS group_id, turn AS observation_index, CASE WHEN regexp_matches(trim(coalesce(text, '')), '\?$') THEN 'question' WHEN regexp_matches(lower(coalesce(text, '')), '^(please|show|tell|give)\b') THEN 'request' WHEN length(trim(coalesce(text, ''))) < 20 THEN 'acknowledgement' ELSE 'statement' END AS act FROM conversations")
def dialogue_act_filter(spark, d):
    t = F.trim("content")
    act = F.when(t.rlike(r"\?$"), "question").when(F.lower("content").rlike(r"^(please|show|tell|give)\b"), "request").when(F.length(t) < 20, "acknowledgement").otherwise("statement")
    return S.observations(spark, d).select("group_id", "observation_index", act.alias("act"))


@query("WITH x AS (SELECT source, count(*) FILTER (length(text) < 200 AND quality = 0) AS tp, count(*) FILTER (length(text) < 200) AS p, count(*) FILTER (quality = 0) AS g FROM documents JOIN labels USING (doc_id) GROUP BY 1), y AS (SELECT source, CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / p END AS pr, CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN g = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / g END AS re FROM x) SELECT source, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM y")
def prf_metrics(spark, d):
    j = S.read(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")).join(S.read(spark, d, "labels"), "doc_id")
    g = j.groupBy("source").agg(F.count_if((F.col("n") < 200) & (F.col("quality") == 0)).alias("tp"), F.count_if(F.col("n") < 200).alias("p"), F.count_if(F.col("quality") == 0).alias("g"))
    return g.select("source", *metrics.prf(F.col("tp"), F.col("p"), F.col("g")))


@query(f"""WITH b AS (SELECT item_id, {TOK.format('text')} AS t FROM benchmark), p AS (SELECT a.item_id, a.t AS p, b.t AS r FROM b a JOIN b ON b.item_id = a.item_id + 1),
pc AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(p) AS w FROM p) GROUP BY ALL), rc AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(r) AS w FROM p) GROUP BY ALL),
tp AS (SELECT item_id, sum(least(pc.n, rc.n)) AS tp FROM pc JOIN rc USING (item_id, w) GROUP BY 1), x AS (SELECT item_id, len(p) AS np, len(r) AS nr, coalesce(tp, 0) AS tp FROM p LEFT JOIN tp USING (item_id)), y AS (SELECT item_id, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / np END AS pr, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN nr = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / nr END AS re FROM x)
SELECT item_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM y""")
def token_f1(spark, d):
    b = S.read(spark, d, "benchmark").select("item_id", T.tokens(F.coalesce("text", F.lit(""))).alias("p"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("p").alias("r")), "item_id")
    return metrics.token_f1(pairs, "p", "r", "item_id")


@query("WITH a AS (SELECT user_id, avg(value) FILTER (event_type = 'purchase') AS p, avg(value) FILTER (event_type = 'view') AS v FROM events GROUP BY 1) SELECT count(*) FILTER (p > v) AS wins, count(*) FILTER (p < v) AS losses, count(*) FILTER (p = v) AS draws, round(avg(p - v), 6) AS mean_delta FROM a")
def paired_wins(spark, d):
    a = S.read(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("p"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("v"))
    return a.agg(F.count_if(F.expr("p > v")).alias("wins"), F.count_if(F.expr("p < v")).alias("losses"), F.count_if(F.expr("p = v")).alias("draws"), F.round(F.avg(F.expr("p - v")), 6).alias("mean_delta"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    return windows.tumbling(S.read(spark, d, "events"))


@query("WITH b AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start FROM events) SELECT window_start, count(*) AS n FROM b GROUP BY 1")
def sliding_window(spark, d):
    return windows.sliding(S.read(spark, d, "events"))


@query("WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f) SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY 1, 2")
def session_window(spark, d):
    return windows.sessions(S.read(spark, d, "events"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    li = S.read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, d):
    return S.read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lineitem(spark, d):
    return S.read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("(SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    c = S.read(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    out = c.intersect(S.read(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))
    return out.subtract(S.read(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("nationkey")))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot_events(spark, d):
    return S.read(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count("event_id")).na.fill(0)
