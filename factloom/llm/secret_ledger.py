"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Each text version is a blob named by its SHA-256. A ledger holds the (blob, rule, version) pairs that have been
scanned and a findings table holds their spans; a scan reads only blobs that lack a pair with a current rule version,
once for each distinct blob, and the findings are joined back to all documents (paths) that hold the blob.

Spans come from the built-in functions: the pieces between matches (split) and the matches (regexp_extract_all) have
known lengths, whose running sums are the spans, in code points. Defined cases: null text is the empty text; empty
texts have no findings; equal rows share a blob and get a row each; rows without a doc_id are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the contract: kind, version, Java pattern, group whose length counts, least length of it.
RULES = [
    ("assign", 1, r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", 1, r"[0-9a-f]{32,}", 0, 32),
]
SPANS = "array<struct<start:int,end:int>>"
#: Matches of a text whose spans are built together.
RUN = 128
#: Copies of a finding row over which the paths of one blob are dealt.
SALTS = 16


def let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), f)[0]


def spans_of(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,end>> of the leftmost non-overlapping matches whose group has ``least`` code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.arrays_zip(gaps.alias("g"), F.transform(hits, lambda x: F.length(x)).alias("m"), F.transform(counted, lambda x: F.length(x)).alias("c"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, r):
        begin = acc["at"] + r["g"]
        end = begin + F.coalesce(r["m"], F.lit(0))
        return F.struct(end.alias("at"), F.when(r["c"] >= least, F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    # an appended array is copied, so it grows in runs of RUN matches, whose spans are then moved to the runs' places
    runs = let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1, F.lit(RUN)), lambda i: F.aggregate(F.slice(r, i + 1, RUN), zero, step)))
    begins = lambda d: F.aggregate(d, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    moved = lambda z: F.transform(z["d"]["out"], lambda s: F.struct((s["start"] + z["b"]).alias("start"), (s["end"] + z["b"]).alias("end")))
    spans = let(runs, lambda d: F.flatten(F.transform(F.arrays_zip(d.alias("d"), begins(d).alias("b")), moved)))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPANS))


def blobs(documents: DataFrame) -> DataFrame:
    """doc_id, blob, text: the content address of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan(documents: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules=RULES):
    """(findings, ledger) after scanning what the ledger lacks.

    ledger: blob, rule, version. findings: blob, rule, version, start, end. Earlier rows of other versions stay.
    """
    named = blobs(documents)
    spark = documents.sparkSession
    want = named.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    todo = want.withColumn("rules", F.array(*[F.lit(r[0]) for r in rules]))
    if ledger is not None:
        current = spark.createDataFrame([(r[0], r[1]) for r in rules], "rule string, version int")
        seen = ledger.join(F.broadcast(current), ["rule", "version"]).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("rules", F.array_except("rules", F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    todo = todo.select(F.col("doc_id").alias("_doc"), F.col("blob").alias("_blob"), "rules")
    # a blob that only rows without a doc_id hold has a null _doc
    texts = named.join(todo, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "blob", "text", "rules")
    return _scanned(texts, ledger, findings, rules)


def _scanned(texts: DataFrame, ledger, findings, rules):
    def tagged(kind, version, pattern, group, least):
        spans = F.when(F.array_contains("rules", kind), spans_of(F.col("text"), pattern, group, least)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("rule"), F.lit(version).alias("version"), s["start"].alias("start"), s["end"].alias("end")))

    each = [tagged(*rule) for rule in rules]
    found = texts.select("blob", F.explode(F.concat(*each)).alias("f")).select("blob", "f.*")
    done = texts.select("blob", F.explode("rules").alias("rule")).distinct()
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r[0], r[1])])
    done = done.select("blob", "rule", versions[F.col("rule")].alias("version"))
    return (found if findings is None else findings.unionByName(found)), (done if ledger is None else ledger.unionByName(done))


def per_document(documents: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, blob, found (array of start, rank, end, rule; sorted): findings joined back to every path, salted per blob."""
    current = F.lit(False)
    rank = F.lit(0)
    for i, (kind, version, *_) in enumerate(rules):
        current = current | ((F.col("rule") == kind) & (F.col("version") == version))
        rank = F.when(F.col("rule") == kind, i).otherwise(rank)
    by_blob = findings.where(current).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "rule"))).alias("found"))
    salted = by_blob.select("blob", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    paths = blobs(documents).select("doc_id", "blob", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = paths.join(salted, ["blob", "salt"], "left")
    return out.select("doc_id", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,end:int,rule:string>>")).alias("found"))


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with each span (overlaps joined) replaced by ``mark``; all columns kept, n_chars follows the text."""
    findings, _ = scan(documents)
    hit = per_document(documents, findings).where(F.size("found") > 0).dropDuplicates(["doc_id", "blob"])
    own = "_hit"
    while any(c.lower().startswith(own) for c in documents.columns):  # columns of that name are the user's
        own += "_"
    hit = hit.select(F.col("doc_id").alias(f"{own}doc"), F.col("blob").alias(f"{own}blob"), F.col("found").alias(f"{own}spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    both = documents.join(hit, F.col("doc_id").eqNullSafe(F.col(f"{own}doc")) & (F.unhex(F.sha2(text, 256)) == F.col(f"{own}blob")), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    fold = F.aggregate(
        f"{own}spans",
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    new = both.withColumn("text", F.when(F.col(f"{own}spans").isNotNull(), fold).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        new = new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return new.select(*documents.columns)
