"""Queries over grounding, goal paths, order of arrival and comparison of extractions, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import grounding
from factloom.functions import text as T
from factloom.operators import dependency, evaluation, paths, question_plan, shadowing
from factloom.plans.catalogue import SENT, TOK, query
from factloom.plans.state_queries import FS, NORM
from factloom.sources import adapters as S
from factloom.sources import snapshot

NOT = grounding.NEGATION.replace("'", "''")


def _plain(c: str) -> str:
    return f"regexp_replace({c}, '[_-]', ' ', 'g')"


def _said(c: str) -> str:
    return f"list_filter({TOK.format(_plain(c))}, lambda w: NOT list_contains({grounding.POLAR_WORDS}, w))"


def _roots(c: str) -> str:
    return f"list_distinct(list_transform({_said(c)}, lambda w: regexp_replace(CASE WHEN starts_with(w, 'un') AND length(w) > 4 THEN substr(w, 3) ELSE w END, '{grounding.ROOT}', '\\1')))"


def _negative(c: str) -> str:
    return f"(regexp_matches(lower({_plain(c)}), '{NOT}') OR len(list_filter({_said(c)}, lambda w: starts_with(w, 'un') AND length(w) > 4)) > 0)"


@query(f"""WITH {FS}, a AS (SELECT state_id, cond, attribute || '_state' AS att, CASE k % 4 WHEN 0 THEN attribute WHEN 1 THEN 'not ' || attribute WHEN 2 THEN 'un' || attribute ELSE attribute || 's' END AS v, span || ' in mode ' || (k % 3) AS e FROM fs),
b AS (SELECT *, {_roots('v')} AS vr, {_roots('e')} AS er, {_roots('att')} AS ar, {_negative('v')} AS vn, {_negative('e')} AS en FROM a)
SELECT state_id, len(vr) > 0 AND list_has_all(er, vr) AND vn = en AS value_grounded, list_has_any(vr, er) AND vn <> en AS polarity_conflict, list_has_any(ar, er) OR contains(lower(e), replace(att, '_', ' ')) AS attribute_grounded, CAST(len(list_filter(cond, lambda x: contains(lower(e), x.key) AND contains(lower(e), x.value))) AS BIGINT) AS n_conditions FROM b""")
def value_grounding(spark, d):
    """Which values, attributes and conditions of states their evidence bears out, by roots and polarity."""
    k, a = F.col("k"), F.col("attribute")
    value = F.when(k % 4 == 0, a).when(k % 4 == 1, F.concat(F.lit("not "), a)).when(k % 4 == 2, F.concat(F.lit("un"), a)).otherwise(F.concat(a, F.lit("s")))
    s = S.full_states(spark, d).select("state_id", "cond", F.concat(a, F.lit("_state")).alias("att"), value.alias("v"), F.concat("span", F.lit(" in mode "), (k % 3).cast("string")).alias("e"))
    s = s.withColumns({"v": grounding.meaning(F.col("v")), "m": grounding.meaning(F.col("e"))})
    v, m, e = F.col("v"), F.col("m"), F.col("e")
    return s.select("state_id", grounding.value_grounded(v, m).alias("value_grounded"), grounding.polarity_conflicts(v, m).alias("polarity_conflict"), grounding.attribute_grounded(F.col("att"), e, m).alias("attribute_grounded"), F.size(grounding.grounded_conditions(F.col("cond"), e)).cast("long").alias("n_conditions"))


OPENING = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in grounding.OPENINGS.items())


@query(f"""WITH s AS (SELECT lower(trim(unnest({SENT}))) AS t FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents))
SELECT CASE WHEN regexp_matches(t, '{grounding.CONDITIONAL}') THEN 'conditional' WHEN regexp_matches(t, '{grounding.NEGATIVE}') THEN 'negative' WHEN regexp_matches(t, '{grounding.PAST}') THEN 'historical' ELSE 'positive' END AS polarity, CASE {OPENING} ELSE 'none' END AS opening, count(*) AS n FROM s GROUP BY ALL""")
def sentence_polarity(spark, d):
    """Sentences of all turns and documents by polarity and by what they open with."""
    text = S.read(spark, d, "conversations").select("text").unionByName(S.read(spark, d, "documents").select("text"))
    s = text.select(F.explode(T.sentences(F.coalesce("text", F.lit("")))).alias("t"))
    return s.groupBy(grounding.polarity(F.col("t")).alias("polarity"), F.coalesce(grounding.opening(F.col("t")), F.lit("none")).alias("opening")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS o, ['p' || o_orderkey, 'c' || c_custkey, 'n' || c_nationkey] AS path, c_nationkey AS n, 0 AS hints, 0.5 + 0.25 * (c_custkey % 3) + 1.0 AS score FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 5 > 0
UNION ALL SELECT o_orderkey, ['q' || o_orderkey || '-' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey], s_nationkey, CASE WHEN s_suppkey % 4 > 0 THEN 2 ELSE 1 END, 0.75 + 1.0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderkey % 7 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY hints DESC, score DESC, path) AS k FROM p)
SELECT 'o' || o AS anchor, array_to_string(path, '>') AS path, 'r' || n_regionkey AS target, CAST(3 AS BIGINT) AS hops, CAST(hints AS BIGINT) AS n_hints, CAST(score AS DOUBLE) AS score FROM r JOIN nation ON n_nationkey = n WHERE k = 1""")
def goal_path_3hop(spark, d):
    """The region each order leads to: over its first supplier where that way is open, else over its customer."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    fact = lambda t, s, r, o, i, w: t.select(s.alias("subject"), r.alias("relation"), o.alias("object"), i.alias("state_id"), w.alias("score"))
    o, li, c, s, n = (S.read(spark, d, x) for x in ("orders", "lineitem", "customer", "supplier", "nation"))
    first = li.where("l_linenumber = 1").select("l_orderkey", "l_suppkey")
    based = F.when(F.col("s_suppkey") % 4 > 0, "based_in").otherwise("near")
    facts = fact(o, key("o", "o_orderkey"), F.lit("placed_by"), key("c", "o_custkey"), key("p", "o_orderkey"), F.lit(0.5))
    facts = facts.union(fact(first, key("o", "l_orderkey"), F.lit("shipped_by"), key("s", "l_suppkey"), F.concat(key("q", "l_orderkey"), key("-", "l_suppkey")), F.lit(0.5)))
    facts = facts.union(fact(c, key("c", "c_custkey"), F.lit("resides_in"), key("n", "c_nationkey"), key("c", "c_custkey"), 0.25 * (F.col("c_custkey") % 3)))
    facts = facts.union(fact(s, key("s", "s_suppkey"), based, key("n", "s_nationkey"), key("s", "s_suppkey"), F.lit(0.25)))
    facts = facts.union(fact(n, key("n", "n_nationkey"), F.lit("located_in"), key("r", "n_regionkey"), key("n", "n_nationkey"), F.lit(1.0)))
    shut = o.where("o_custkey % 5 = 0").select(key("o", "o_orderkey").alias("anchor"), key("c", "o_custkey").alias("entity"))
    shut = shut.union(first.where("l_orderkey % 7 = 0").select(key("o", "l_orderkey"), key("s", "l_suppkey")))
    return paths.goal_paths(facts, o.select(key("o", "o_orderkey").alias("anchor")), "located_in", ["shipped_by", "based_in"], shut)


@query("WITH c AS (SELECT conv_id AS group_id, turn AS position, sha256(role || chr(31) || coalesce(text, '')) AS observation_id FROM conversations), f AS (SELECT *, min(position) OVER (PARTITION BY group_id, observation_id) AS first FROM c) SELECT group_id, position, observation_id, dense_rank() OVER (PARTITION BY group_id ORDER BY first, observation_id) - 1 AS observation_index FROM f")
def observation_order(spark, d):
    """Index of each turn's observation in its conversation; a repeated turn is a replay."""
    o = S.observations(spark, d).select("group_id", F.col("observation_index").alias("position"), T.content_id(F.col("speaker"), F.col("content")).alias("observation_id"))
    return snapshot.observation_index(o).select("group_id", "position", "observation_id", "observation_index")


@query("""WITH x AS (SELECT doc_id, length(coalesce(text, '')) AS n, unnest(range(greatest(1, CAST(ceil((length(coalesce(text, '')) - 200) / 800.0) AS BIGINT)))) AS i FROM documents), r AS (SELECT doc_id, n, i * 800 AS a, least(n, i * 800 + 1000) AS b FROM x WHERE (doc_id + i) % 17 <> 5 OR i = 0), q AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM r)
SELECT doc_id, count(*) AS n_ranges, CAST(sum(greatest(0, least(b, z) - a)) AS BIGINT) AS n_repeated, NOT bool_or(a > z) AND max(b) = max(n) AS lossless FROM q GROUP BY 1""")
def chunk_cover(spark, d):
    """Whether the windows of a document cover it whole; every seventeenth window is left out."""
    t = F.length(F.coalesce("text", F.lit(""))).cast("long")
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil((F.col("length") - 200) / 800.0)).cast("long") - 1)).alias("i")
    r = S.read(spark, d, "documents").select("doc_id", t.alias("length")).select("doc_id", "length", i).where("(doc_id + i) % 17 <> 5 or i = 0")
    return snapshot.lossless(r.select("doc_id", "length", (F.col("i") * 800).alias("start"), F.least("length", F.col("i") * 800 + 1000).alias("end")), "doc_id")


@query("""WITH a AS (SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS a FROM lineitem WHERE l_linenumber % 3 <> 1 GROUP BY ALL), b AS (SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS b FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY ALL),
j AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag), g AS (SELECT l_suppkey, CAST(sum(least(a, b)) AS BIGINT) AS m, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM j GROUP BY 1)
SELECT l_suppkey, m AS matched, a - m AS missing, b - m AS added, round(m / nullif(b, 0), 6) AS precision, round(m / nullif(a, 0), 6) AS recall, a = m AND b = m AS equivalent FROM g""")
def extraction_diff(spark, d):
    """Two extractions of each supplier's lines, compared as multisets."""
    li = S.read(spark, d, "lineitem")
    return evaluation.multiset_diff(li.where("l_linenumber % 3 <> 1"), li.where("l_linenumber % 3 <> 2"), "l_suppkey", ["l_partkey", "l_returnflag"])


@query("WITH e AS (SELECT CASE WHEN CAST(props->>'k' AS BIGINT) % 10 > 0 THEN event_type ELSE 'unattributed' END AS stage, CAST(floor(value) AS BIGINT) AS v FROM events), g AS (SELECT stage, count(*) AS n, CAST(sum(v) AS DOUBLE) AS s FROM e GROUP BY 1) SELECT stage, n, s AS seconds, round(100 * s / sum(s) OVER (), 6) AS percent FROM g")
def stage_profile(spark, d):
    """Time by stage, and what no stage accounts for."""
    e = S.read(spark, d, "events").select(F.when(F.get_json_object("props", "$.k").cast("long") % 10 > 0, F.col("event_type")).alias("stage"), F.floor("value").cast("double").alias("seconds"))
    return evaluation.stage_profile(e)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_discount > 0.03 AS eligible, {'a': CAST(l_quantity AS BIGINT) % 4, 'b': l_suppkey, 'c': l_linenumber} AS r FROM lineitem), m AS (SELECT *, max(CASE WHEN eligible THEN r END) OVER (PARTITION BY l_orderkey) AS best FROM c)
SELECT l_orderkey AS dependent, l_linenumber AS position, eligible, best IS NULL OR r >= best AS kept FROM m""")
def competing_sources(spark, d):
    """Of the lines an order may depend on, those that no eligible one beats."""
    c = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("dependent"), (F.col("l_discount") > 0.03).alias("eligible"), (F.col("l_quantity").cast("long") % 4).alias("overlap"), F.col("l_suppkey").alias("state_order"), F.col("l_linenumber").alias("position"))
    return dependency.competing(c).select("dependent", "position", "eligible", "kept")


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE 'well' || chr(10) || 'Answer: ' || coalesce(text, '') END AS a, coalesce(text, '') AS own, lead(text) OVER w AS r1, lead(text, 2) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT conv_id, turn, 0 AS form, a AS p, r1, r2 FROM t UNION ALL SELECT conv_id, turn, 1, CASE WHEN regexp_matches(a, '(?i)answer:') THEN trim(regexp_replace(trim(regexp_extract(a, '(?i)answer:([^\\n]*)', 1)), '(?i)^answer:', '')) ELSE nullif(trim(string_split(a, chr(10))[1]), '') END, r1, r2 FROM t),
q AS (SELECT conv_id, turn, form, x, {NORM.format('p')} AS p, {NORM.format('r')} AS r FROM (SELECT conv_id, turn, form, p, 1 AS x, r1 AS r FROM f UNION ALL SELECT conv_id, turn, form, p, 2, r2 FROM f) WHERE p IS NOT NULL AND r IS NOT NULL),
a AS (SELECT conv_id, turn, form, x, w, count(*) AS n FROM (SELECT conv_id, turn, form, x, unnest(p) AS w FROM q) GROUP BY ALL), b AS (SELECT conv_id, turn, form, x, w, count(*) AS n FROM (SELECT conv_id, turn, form, x, unnest(r) AS w FROM q) GROUP BY ALL), tp AS (SELECT conv_id, turn, form, x, sum(least(a.n, b.n)) AS tp FROM a JOIN b USING (conv_id, turn, form, x, w) GROUP BY ALL)
SELECT q.conv_id AS group_id, q.turn AS observation_index, max(CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0.0 END) AS exact, max(CASE WHEN contains(array_to_string(p, ' '), array_to_string(r, ' ')) THEN 1.0::DOUBLE ELSE 0.0 END) AS contained, max(CAST(round(CASE WHEN p <> r AND (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(r, ' ') IN ('yes', 'no', 'noanswer')) THEN 0 WHEN len(p) = 0 OR len(r) = 0 THEN CASE WHEN p = r THEN 1 ELSE 0 END WHEN coalesce(tp, 0) = 0 THEN 0 ELSE 2.0 * tp / (len(p) + len(r)) END, 6) AS DOUBLE)) AS f1 FROM q LEFT JOIN tp USING (conv_id, turn, form, x) GROUP BY 1, 2""")
def best_answers(spark, d):
    """Each turn as an answer, marked or not, against the two turns after it."""
    w = W.partitionBy("group_id").orderBy("observation_index")
    o = S.read(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("observation_index"), "text")
    answer = F.when(F.col("observation_index") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise(F.concat(F.lit("well\nAnswer: "), F.coalesce("text", F.lit(""))))
    o = o.select("group_id", "observation_index", answer.alias("answer"), F.array_compact(F.array(F.lead("text").over(w), F.lead("text", 2).over(w))).alias("references"))
    return evaluation.best_answer(o, ["group_id", "observation_index"], "answer", "references")


@query(rf"""WITH {FS}, x AS (SELECT * REPLACE (regexp_replace(span, '^separate', 'unrelated') AS span), date_trunc('day', observed_at) AS day, CASE WHEN k % 19 = 0 THEN 'STALE' ELSE 'CURRENT' END AS status, CASE k % 4 WHEN 0 THEN attribute WHEN 1 THEN attribute || '_state' END AS field FROM fs),
y AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(value || ' ' || span), '\w+')), lambda w: w <> CAST(entity AS VARCHAR) AND NOT list_contains({shadowing.PROVENANCE_STOPWORDS}, w)) AS said, starts_with(span, entity || ' ') AS direct, starts_with(span, 'unrelated') AS meta FROM x)
SELECT DISTINCT a.state_id FROM y a JOIN y b ON a.entity = b.entity WHERE a.status = 'CURRENT' AND CASE WHEN b.status = 'STALE' THEN a.observed_at < b.observed_at AND NOT coalesce(a.t1 <= b.t0, false) AND NOT coalesce(b.t1 <= a.t0, false) AND (a.attribute = b.attribute OR len(list_intersect(a.said, b.said)) >= 2)
ELSE a.state_id <> b.state_id AND (a.attribute = b.attribute OR (a.k % 4 < 2 AND b.k % 4 < 2 AND len(list_intersect(a.said, b.said)) >= 2)) AND CASE WHEN a.day <> b.day THEN a.observed_at < b.observed_at WHEN (a.meta AND b.direct) OR (a.direct AND b.meta) THEN false WHEN a.value <> b.value THEN false WHEN a.span = b.span THEN a.state_id > b.state_id ELSE a.state_id < b.state_id END END""")
def continuity_shadowing(spark, d):
    """Current states that newer ones of their user hide from a question of continuity."""
    k = F.col("k")
    s = S.full_states(spark, d).select(
        "state_id", F.col("entity").cast("string").alias("entity"), "attribute", "value", F.regexp_replace("span", "^separate", "unrelated").alias("span"),
        F.when(k % 4 == 0, F.col("attribute")).when(k % 4 == 1, F.concat("attribute", F.lit("_state"))).alias("field"),
        F.date_trunc("day", "observed_at").alias("observation_id"), F.col("state_id").alias("sequence_index"), "observed_at", "t0", "t1", F.when(k % 19 == 0, "STALE").otherwise("CURRENT").alias("status"),
    )
    return shadowing.shadowed(s, "does the user still do that")


@query("""SELECT c_custkey AS question_id, CASE WHEN c_custkey % 5 < 4 THEN lower(replace(c_name, '#', ' ')) END AS anchor,
CASE c_custkey % 5 WHEN 0 THEN 'residence' WHEN 1 THEN 'occupation' WHEN 2 THEN 'citizenship' WHEN 3 THEN 'residence' END AS goal,
CASE c_custkey % 5 WHEN 2 THEN 'occupation' WHEN 3 THEN 'citizenship>occupation' ELSE '' END AS hints,
CAST(CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS BIGINT) AS hops FROM customer""")
def question_plans(spark, d):
    """Anchor, goal, hints and hops of a question about every customer, over facts of home, job and nationality."""
    c, n = S.read(spark, d, "customer"), S.read(spark, d, "nation")
    who = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("c"), F.col("n_name").alias("n"))
    k, said = F.col("c_custkey") % 5, lambda *parts: F.concat(*[F.col(x) if x in ("c", "n") else F.lit(x) for x in parts])
    text = (
        F.when(k == 0, said("Where does ", "c", " live?")).when(k == 1, said("What is the job of ", "c", " in ", "n", "?"))
        .when(k == 2, said("Where is the country of the job of ", "c", " in ", "n", "?"))
        .when(k == 3, said("Is ", "c", " a citizen, and where does the role lead home?")).otherwise("Who knows?")
    )
    facts = S.triples(spark, d).select("subject", "relation").unionByName(c.select(F.col("c_name").alias("subject"), F.explode(F.array(F.lit("job"), F.lit("nationality"))).alias("relation")))
    return question_plan.plans(who.select(F.col("c_custkey").alias("question_id"), text.alias("text")), facts).withColumn("hints", F.array_join("hints", ">"))
