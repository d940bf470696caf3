"""The thin opN_<name> queries: digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import packing as op

    pieces = op.pack(table(spark, sf_dir, "documents"), window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import secret_ledger as op

    docs = table(spark, sf_dir, "documents")
    findings, _ = op.scan(docs)
    found = op.per_document(docs, findings)
    count = lambda kind: F.size(F.filter("found", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import toxicity as op

    out = op.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("p_junk", 6).alias("p_junk"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import jaccard_join as op

    return op.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import recompression as op

    return op.dedup(table(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import suffix_blocks as op

    return op.dedup(table(spark, sf_dir, "documents"), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import decontaminate as op

    return op.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import repetition as op

    return op.rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import training_order as op

    return op.materialise(table(spark, sf_dir, "documents"))


def op10_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import html_tree as op

    return op.extract(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import fill_in_middle as op

    out = op.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(op.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import max_sketch as op

    return op.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import additive as op

    return op.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_secret_ledger, op3_toxicity_chain, op4_jaccard_join, op5_recompression, op6_suffix_blocks, op7_decontaminate, op8_repetition_rules, op9_training_order, op10_html_tree, op11_fill_in_middle, op12_max_sketch, op13_additive_quality)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def windows_of(size: int) -> str:
    """SQL: w(doc_id, i, key) for the windows of ``size`` words of d(doc_id, w), counted from 1."""
    return f"SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d)"


def spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """SQL: list of spans of one rule, from the lengths of matches and of the pieces between them."""
    m, c, g = f"regexp_extract_all(t, '{pattern}', 0)", f"regexp_extract_all(t, '{pattern}', {group})", f"regexp_split_to_array(t, '{pattern}')"
    begin = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    one = f"{{'start': CAST({begin} AS BIGINT), 'rank': {rank}, 'end': CAST({begin} + length(m[i]) AS BIGINT), 'rule': '{kind}'}}"
    return f"(SELECT list_transform(list_filter(range(1, len(m) + 1), lambda i: length(c[i]) >= {least}), lambda i: {one}) FROM (SELECT {m} AS m, {c} AS c, {g} AS g))"


_RULES = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
_SPANS = " || ".join(spans_sql(kind, i, p, group, least) for i, (kind, p, group, least) in enumerate(_RULES))

#: Twins of the operators that SQL can express in seconds on whole tables (op6 takes ten minutes: see its brute-force test).
ORACLE_SQL: dict[str, str] = {
    "op2_secret_ledger": f"""WITH s AS (SELECT doc_id, list_sort({_SPANS}) AS f FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), j AS (SELECT *, array_to_string(list_transform(f, lambda s: s.rule || ':' || s.start || ':' || s."end"), ',') AS spans FROM s)
SELECT doc_id, len(list_filter(f, lambda s: s.rule = 'assign')) AS n_assign, len(list_filter(f, lambda s: s.rule = 'access')) AS n_access, len(list_filter(f, lambda s: s.rule = 'hex')) AS n_hex, sha256(spans) AS base_sha256, spans FROM j""",
    "op4_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), g AS (SELECT DISTINCT doc_id, key FROM ({windows_of(3)}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.key = b.key AND a.doc_id <> b.doc_id GROUP BY 1, 2), l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node) SELECT r.node AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node""",
    "op5_recompression": f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), k AS ({windows_of(13)}), f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY 1), x AS (SELECT DISTINCT k.doc_id, k.i + o AS p FROM k JOIN f USING (key), range(13) v(o) WHERE f.first < k.doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d), q AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN x ON x.doc_id = u.doc_id AND x.p = u.p GROUP BY 1), m AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(m.n, 0) AS n_removed, sha256(coalesce(q.kept, '')) AS kept_sha256 FROM d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op8_repetition_rules": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents), d AS (SELECT doc_id, w FROM t),
k3 AS ({windows_of(3)}), c3 AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM k3), range(3) v(o) WHERE c > 1 GROUP BY 1),
k13 AS ({windows_of(13)}), c13 AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM k13), range(13) v(o) WHERE c > 1 GROUP BY 1),
b AS (SELECT t.*, coalesce(c3.n, 0) AS n3, coalesce(c13.n, 0) AS n13, len(w) < 50 OR 100 * coalesce(c3.n, 0) > 50 * len(w) AS failed, CAST(floor(0.35::DOUBLE * len(w)) AS BIGINT) + 1 AS lim FROM t LEFT JOIN c3 ON c3.doc_id = t.doc_id LEFT JOIN c13 ON c13.doc_id = t.doc_id),
z AS (SELECT doc_id FROM (SELECT doc_id, md5(array_to_string(w[i:i + lim - 1], ' ')) AS key FROM (SELECT doc_id, w, lim, unnest(range(1, len(w) - lim + 2)) AS i FROM b WHERE NOT failed AND n3 >= lim)) GROUP BY doc_id HAVING count(DISTINCT key) < count(*))
SELECT b.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, n3 AS n_repeat_words, failed AS base_failed, NOT failed AND n13 <= 0.4::DOUBLE * len(w) AND z.doc_id IS NULL AS kept, n13 AS n_covered FROM b LEFT JOIN z ON z.doc_id = b.doc_id""",
    "op11_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, u, len(u) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, t, n, form, CASE WHEN a > 0 THEN array_to_string(u[1:a], '') ELSE '' END AS pre, CASE WHEN b > a THEN array_to_string(u[a + 1:b], '') ELSE '' END AS mid, CASE WHEN n > b THEN array_to_string(u[b + 1:n], '') ELSE '' END AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_max_sketch": rf"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents), s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM t WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark), q AS (SELECT b, term, count(*) AS times FROM (SELECT b, unnest(w) AS term FROM b) GROUP BY ALL),
f AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL), g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, s GROUP BY term, nn),
i AS (SELECT f.k, f.term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * len(t.w) * nn) // l))) AS impact FROM f JOIN t ON t.k = f.k, s), c AS (SELECT q.b, i.k, CAST(sum(times * weight * impact) AS BIGINT) AS score FROM q JOIN g ON g.term = q.term JOIN i ON i.term = q.term GROUP BY ALL),
r AS (SELECT b, k, score, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c JOIN t USING (k) WHERE score > 0) SELECT item_id, CAST(rank AS INTEGER) AS rank, t.doc_id, score FROM r JOIN b USING (b) JOIN t ON t.k = r.k WHERE rank <= 10""",
}
