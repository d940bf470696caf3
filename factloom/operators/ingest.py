"""Ingest of observations in order, one transaction an observation, for many groups at once.

The rows are dealt out by observation and then by group, once each, into blocks of up to ``BLOCK`` observations that
follow one another in a group and about ``CANDIDATES`` rows: one row with its texts and candidates. A wave takes the next
block of every group beside the group's states in the store. What texts, times and names say of a candidate and the
states it may meet is found for all pairs of the block; the order of a group, in which an observation's candidates are
linked against the states that were active before it and revise them, dependencies are resolved, stale states cascade
and the active ones are checked, is a fold over those few figures (``folding``). What the fold leaves is read off the
block, so texts and states aren't joined to it again. One commit of the store ends the wave. An observation that fails (a
candidate that can't be a state, two active states of one slot and value) leaves its group as it was: none of its states,
evidence and relations are part of the commit, the log says why, and the group's later observations wait, in this call and in later ones, until it has come again and gone in. One whose index goes back
behind what has been committed is refused. What has been committed is a replay when it comes again and changes nothing.

Rows: group_id, observation_id, observation_index, observed_at, text, and a candidate (null entity: the observation has
none): sequence_index, entity, attribute, value, t0, t1, cond, confidence, span, effects, conflicts (selectors of
states it ends or contradicts), depends (selectors of states it rests on, each with a strength).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import evidence, identity, scope
from factloom.operators import conflict, dependency, folding, linking, selectors
from factloom.sources.durable import removed, shared_folder, written
from factloom.sources.store import CONDITIONS, Store

SELECTOR = "struct<entity:string,attribute:string,value:string>"
DEPENDENCY = "struct<entity:string,attribute:string,value:string,strength:string>"
ROW = f"""group_id string, observation_id string, observation_index long, observed_at timestamp_ntz, text string, sequence_index long, entity string, attribute string, value string, t0 timestamp_ntz, t1 timestamp_ntz, cond {CONDITIONS}, confidence double, span string, effects array<{SELECTOR}>, conflicts array<{SELECTOR}>, depends array<{DEPENDENCY}>"""
NAME = ["group_id", "observation_id"]
#: A group's share of a wave: so many observations, and rows but for what the first one has over; one with more rows than that is alone. Pairs within it grow with its square.
BLOCK, CANDIDATES = 64, 512
#: What a state is compared by (see ``conflict``).
COMPARED = ["state_id", "entity", "attribute", "value", "t0", "t1", "cond", "confidence", "observed_at", "observation_index", "sequence_index", "span"]
#: What a block holds of a state: its row in the store, and where its observation stands.
STATE = "state_id version_id slot_id entity attribute value status uncertainty revalidate t0 t1 cond confidence observed_at observation_id observation_index sequence_index span evidence_ids duplicate_of place".split()


def _id(prefix: str, *parts: Column) -> Column:
    """A content id: parts in order, null apart from empty."""
    return identity.digest(prefix, F.concat(*[F.concat(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")), F.lit("\x1f")) for p in parts]))


def slot_id() -> Column:
    t0, t1 = scope.semantic_scope(F.col("t0"), F.col("t1"), F.col("observed_at"))
    return _id("slot", F.col("group_id"), identity.norm(F.col("entity")), identity.attribute_id(F.col("attribute")), t0, t1, F.to_json("cond"))


def value_key() -> Column:
    return identity.state_value(F.col("attribute"), F.col("value"))


def prepared(rows: DataFrame) -> DataFrame:
    """Candidates with ids, defaults in place, and ``fault``: why one can't be a state."""
    none = F.array().cast(CONDITIONS)
    r = rows.withColumn("cond", F.coalesce(F.array_sort("cond"), none)).withColumn("confidence", identity.confidence(F.col("confidence")))
    for c, kind in (("effects", SELECTOR), ("conflicts", SELECTOR), ("depends", DEPENDENCY)):
        r = r.withColumn(c, F.coalesce(c, F.array().cast(f"array<{kind}>")))
    r = r.withColumn("sequence_index", F.coalesce("sequence_index", F.lit(0)))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    is_one = F.col("entity").isNotNull() | F.col("attribute").isNotNull() | F.col("value").isNotNull()
    fault = F.when(is_one & (blank(F.col("entity")) | blank(F.col("attribute")) | F.col("value").isNull()), "INCOMPLETE_CANDIDATE").when(F.col("t1") < F.col("t0"), "INVERTED_VALIDITY")
    r = r.withColumn("is_candidate", is_one).withColumn("fault", fault)
    r = r.withColumn("evidence_id", _id("evidence", F.col("group_id"), F.col("observation_id"), F.coalesce("span", "text")))
    r = r.withColumn("slot_id", slot_id())
    r = r.withColumn("version_id", _id("version", F.col("slot_id"), value_key(), F.col("observation_id")))
    return r.withColumn("state_id", _id("state", F.col("version_id"), F.col("sequence_index"), F.col("attribute"), F.col("value")))


def observations(rows: DataFrame) -> DataFrame:
    """One row for each observation of ``rows``: index, time, its texts, n rows, fault, and its candidates as states to be.

    Candidates of one slot and value in one observation are one: the first, its confidence the greatest of them. ``tells``:
    the candidate's span is evidence of its own. One shuffle, in which the rows of an observation travel together.
    """
    r = prepared(rows.repartition(*NAME))
    one = W.partitionBy(*NAME, "is_candidate", "version_id")
    first = F.row_number().over(one.orderBy("sequence_index", "state_id"))
    r = r.withColumn("confidence", F.max("confidence").over(one)).withColumn("_kept", F.col("is_candidate") & (first == 1))
    told = W.partitionBy(*NAME, "_kept", "evidence_id").orderBy("sequence_index", "state_id")
    r = r.withColumn("tells", F.col("_kept") & F.col("span").isNotNull() & (F.row_number().over(told) == 1))
    r = r.withColumn("source", F.col("text")).withColumn("evidence_ids", F.array("evidence_id")).withColumn("revalidate", F.lit(False)).withColumn("place", F.lit(0))
    null = lambda c: F.lit(None).cast("string").alias(c)
    unset = ("status", "uncertainty", "duplicate_of")
    state = F.struct(*[null(c) if c in unset else F.col(c) for c in STATE], "effects", "conflicts", "depends", "tells", "source")
    o = r.groupBy(*NAME).agg(F.min("observation_index").alias("observation_index"), F.min("observed_at").alias("observed_at"), F.min("fault").alias("fault"), F.array_sort(F.collect_set("text")).alias("texts"), F.collect_list(F.when(F.col("_kept"), state)).alias("new"))
    # a text is stated once: by its observation, not again by a span that is all of it or by each candidate
    source = lambda x: F.when(~x["source"].eqNullSafe(F.get("texts", F.lit(0))), x["source"])
    new = F.transform("new", lambda x: x.withField("tells", x["tells"] & ~F.coalesce(F.array_contains("texts", x["span"]), F.lit(False))).withField("source", source(x)))
    return o.withColumn("new", F.when(F.col("fault").isNull(), new).otherwise(F.array().cast(o.schema["new"].dataType)))


def planned(rows: DataFrame, log: DataFrame) -> DataFrame:
    """group_id, observation_id, place (their order in the group), block and last (the group's index before it) of what isn't in the log (committed observations)."""
    every = rows.groupBy(*NAME).agg(F.min("observation_index").alias("observation_index"), F.count("*").alias("n"))
    ahead = every.join(log.select(*NAME), NAME, "left_anti").join(log.groupBy("group_id").agg(F.max("observation_index").alias("_last")), "group_id", "left")
    w = W.partitionBy("group_id").orderBy("observation_index", "observation_id")
    before = F.max("observation_index").over(w.rowsBetween(W.unboundedPreceding, -1))
    p = ahead.withColumn("place", F.row_number().over(w) - 1).withColumn("last", F.coalesce(F.greatest("_last", before), F.lit(-1))).withColumn("_part", F.floor(F.col("place") / BLOCK))
    part, alone = W.partitionBy("group_id", "_part").orderBy("place"), (F.col("n") > CANDIDATES).cast("int")
    p = p.withColumn("_full", F.floor((F.sum("n").over(part) - 1) / CANDIDATES)).withColumn("_cut", 2 * F.sum(alone).over(part) - alone)
    return p.select(*NAME, "place", (F.dense_rank().over(W.partitionBy("group_id").orderBy("_part", "_full", "_cut")) - 1).alias("block"), "last")


def blocks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """group_id, block, observations (in no order; each with its new states) of the observations in ``plan``."""
    o = observations(rows).join(plan, NAME)
    new = F.transform("new", lambda x: x.withField("place", F.col("place")))
    one = F.struct("place", "observation_id", "observation_index", "observed_at", "last", "fault", "texts", new.alias("new"))
    return o.groupBy("group_id", "block").agg(F.collect_list(one).alias("observations"))


def pairs(groups: DataFrame) -> DataFrame:
    """group_id and pairs: of each new state and those of its subject, or named by it, that are placed before it, what a link of the two would mean.

    groups: group_id, observations, states. A pair holds the places of the two in ``states`` (n, o); pairs that can't be linked are left
    out. slot: one slot; named: an effect or a conflict names the old one; score as in the pool; conflict, polarity, ended,
    other_field as ``conflict.revised`` needs them.
    """
    norm = lambda c: identity.norm(c.cast("string"))
    asked = lambda x: F.transform(F.concat(*[F.transform(x[c], lambda s: F.struct(*[s[f].alias(f) for f in selectors.FIELDS])) for c in ("effects", "conflicts")]), lambda s: F.struct(*[norm(s[f]).alias(f) for f in selectors.FIELDS]))
    # what texts, names and times say of one state alone is read before any are paired
    own = lambda x: {**{c: x[c] for c in [*COMPARED, "place"]}, **linking.read_once(lambda c: x[c])}
    older = lambda x: {**own(x), "names": F.struct(*[norm(x[f]).alias(f) for f in selectors.FIELDS])}
    newer = lambda x: {**own(x), "effects": x["effects"], "asked": asked(x)}
    side = lambda p, said, which: F.filter(F.transform("states", lambda x, i: F.when(which(x), F.struct(i.alias(f"{p}_at"), *[v.alias(f"{p}_{c}") for c, v in said(x).items()]))), lambda x: x.isNotNull())
    new = lambda x: x["place"] >= 0
    before = F.array_max(F.transform("observations", lambda o: o["place"]))
    each = groups.select("group_id", side("o", older, lambda x: F.when(new(x), x["place"] < before).otherwise(x["status"].isin(dependency.ACTIVE))).alias("old"), side("n", newer, new).alias("new"))
    each = each.select("group_id", "old", F.inline("new"))
    each = each.select(*[c for c in each.columns if c != "old"], F.inline("old")).where("o_place < n_place")
    hit = lambda s: reduce(Column.__and__, [s[f].isNull() | (s[f] == F.col(f"o_names.{f}")) for f in selectors.FIELDS])
    pair = each.withColumn("named", F.coalesce(F.exists("n_asked", hit), F.lit(False))).where("named or n_subject = o_subject")
    # what most of the rest fail by, before texts are compared
    pair = pair.where(F.col("named") | F.coalesce("n_negative", F.lit(False)) | (identity.parts_compatible(F.col("n_parts"), F.col("o_parts")) & conflict.same_scope()))
    pair = linking.weighed(pair.withColumn("linked", F.lit(False))).where("eligible")
    none = F.array().cast("array<string>")
    links = pair.withColumn("slot", (F.col("n_subject") == F.col("o_subject")) & identity.parts_compatible(F.col("n_parts"), F.col("o_parts")) & conflict.same_scope()).withColumn("linked", F.lit(True)).withColumn("n_invalidates", none).withColumn("n_conflicts", none)
    ended = F.coalesce((F.col("conflict") == "CONSISTENT") & (F.col("o_t1") <= F.col("n_observed_at")), F.lit(False))
    other = F.lower("o_attribute") != F.lower("n_attribute")
    said = F.struct(F.col("n_at").alias("n"), F.col("o_at").alias("o"), "score", "slot", "named", "conflict", "polarity", ended.alias("ended"), other.alias("other_field"))
    return conflict.classified(links).groupBy("group_id").agg(F.collect_list(said).alias("pairs"))


def cell(x: Column) -> Column:
    """What the fold needs of a state: status and what follows it, its slot and value as keys, what selectors compare."""
    norm = lambda c: identity.norm(x[c].cast("string"))
    t0, t1 = scope.semantic_scope(x["t0"], x["t1"], x["observed_at"])
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    key = F.concat_ws("\x1f", norm("entity"), identity.attribute_id(x["attribute"]), identity.state_value(x["attribute"], x["value"]))
    depends = F.transform(x["depends"], lambda s: F.struct(*[identity.norm(s[f]).alias(f) for f in selectors.FIELDS], s["strength"].alias("strength")))
    kept = ["state_id", "version_id", "slot_id", "status", "uncertainty", "revalidate", "confidence", "evidence_ids", "duplicate_of", "observation_index", "sequence_index", "cond", "place"]
    return F.struct(*[x[c].alias(c) for c in kept], norm("entity").alias("entity"), norm("attribute").alias("attribute"), norm("value").alias("value"), key.alias("key"), micros(t0).alias("t0"), micros(t1).alias("t1"), depends.alias("depends"))


def with_relation_ids(relations: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("group_id", "relation_type", "source", "target", "strength", "evidence_id")]
    return relations.withColumn("relation_id", identity.uuid5(F.concat_ws("|", F.lit("relation"), *parts)))


def beside_the_store(store: Store, block: DataFrame) -> DataFrame:
    """The blocks with ``states`` (those of the group that an observation may touch, then the new ones), ``held`` (its dependencies) and ``broken`` (its failed observations)."""
    kind = block.schema["observations"].dataType.elementType["new"].dataType
    new = F.flatten("observations.new")
    edge, bar = "array<struct<source:string,target:string,strength:string>>", "array<struct<observation_id:string,observation_index:bigint>>"
    if not store.load():
        return block.select("group_id", "observations", new.alias("states"), F.array().cast(edge).alias("held"), F.array().cast(bar).alias("broken"))
    groups = written(block.select("group_id").distinct())
    known, held = store.states(groups), store.relations(groups, ["depends-on"]).select("group_id", "source", "target", "strength")
    # besides active states those of versions that a dependency has at an end
    ends = held.select("group_id", F.explode(F.array("source", "target")).alias("state_id")).distinct()
    versions = known.join(ends, ["group_id", "state_id"]).select("group_id", "version_id", F.lit(True).alias("_end")).distinct()
    met = known.join(versions, ["group_id", "version_id"], "left").where(F.col("status").isin(dependency.ACTIVE) | F.col("_end"))
    fill = {"place": F.lit(-1), "tells": F.lit(False), **{c: F.array() for c in ("effects", "conflicts", "depends")}}
    old = F.struct(*[(fill[f.name] if f.name in fill else F.col(f.name) if f.name in met.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])
    listed = lambda df, what, column: df.groupBy("group_id").agg(F.collect_list(column).alias(what))
    failed = store.table("observations", groups).where("status = 'FAILED'")
    out = block.join(listed(met, "old", old), "group_id", "left").join(listed(held, "held", F.struct("source", "target", "strength")), "group_id", "left")
    out = out.join(listed(failed, "broken", F.struct("observation_id", "observation_index")), "group_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("group_id", "observations", F.concat(F.coalesce("old", F.array().cast(kind)), new).alias("states"), empty("held", edge), empty("broken", bar))


def wave(store: Store, block: DataFrame, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables to commit, group_id and what ended it: observation_id, reason) of one block (see ``blocks``) of each group; ``folder`` is for what it keeps."""
    seen = beside_the_store(store, block)
    if store.load():
        seen = written(seen, f"{folder}/seen")
    seen = seen.join(pairs(seen), "group_id", "left")
    brief = F.transform("observations", lambda o: F.struct(*[o[c].alias(c) for c in ("place", "observation_id", "observation_index", "last", "fault")]))
    done = seen.select("group_id", "observations", "states", F.udf(folding.fold, folding.RESULT, useArrow=False)(brief, F.transform("states", cell), "pairs", "held", "broken").alias("r"))
    done = written(done, f"{folder}/done")
    # the fold tells by places in states and observations
    at = lambda x: F.get("observations", x["at"])
    part = lambda what, *columns: done.select("group_id", F.explode(F.transform(f"r.{what}", lambda x: F.struct(*[c(x).alias(n) for n, c in columns]))).alias("x")).select("group_id", "x.*")
    own = lambda *names: [(c, lambda x, c=c: x[c]) for c in names]
    of = lambda *names: [(c, lambda x, c=c: at(x)[c]) for c in names]
    outcome = part("outcomes", *own("observation_id", "status", "reason", "stored"), *of("observation_index", "observed_at"))
    went_in = part("outcomes", *own("observation_id", "status"), *of("observed_at", "texts", "new")).where("status = 'COMMITTED'")
    null = F.lit(None).cast("string")
    whole = F.transform("texts", lambda t: F.struct(_id("evidence", F.col("group_id"), F.col("observation_id"), t).alias("evidence_id"), F.col("observed_at"), t.alias("source_text"), null.alias("span")))
    spans = F.transform(F.filter("new", lambda x: x["tells"]), lambda x: F.struct(x["evidence_ids"][0].alias("evidence_id"), x["observed_at"].alias("observed_at"), F.coalesce(x["source"], F.get("texts", F.lit(0))).alias("source_text"), x["span"].alias("span")))
    told = went_in.select(*NAME, F.explode(F.concat(whole, spans)).alias("x"))
    fixed = [c for c in STATE if c not in folding.CHANGING and c != "place"]
    tables = {
        "observations": outcome.where("stored").drop("stored"),
        "evidence": told.select(*NAME, "x.*"),
        "states": part("states", *[(c, lambda x, c=c: F.get("states", x["at"])[c]) for c in fixed], *own(*folding.CHANGING)),
        "relations": with_relation_ids(part("relations", *own("source", "target", "relation_type", "strength", "reason", "evidence_id"), ("created_at", lambda x: at(x)["observed_at"]))),
    }
    failures = outcome.where("status = 'FAILED'").select(*NAME, "reason")
    stopped = done.where("r.stopped").select("group_id").join(failures, "group_id", "left")
    return tables, stopped


def ingest(store: Store, rows: DataFrame, key: str) -> DataFrame:
    """Commits the observations in ``rows``, group by group in their order; (group_id, observation_id, status, reason).

    status: COMMITTED, REPLAYED (it was in the store), FAILED (with a reason) or WAITING (behind one that failed). The
    store's commits are named by ``key`` and their number, and a run that is repeated goes on where the first one ended.
    """
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/ingest-{uuid.uuid4().hex}"
    rows = written(rows, f"{folder}/rows")
    done = lambda: store.table("observations").where("status = 'COMMITTED'")
    every = rows.select(*NAME).distinct()
    replayed = written(every.join(done().select(*NAME), NAME, "left_semi"))
    every = written(every)
    plan = written(planned(rows, done()), f"{folder}/plan")
    stopped = spark.createDataFrame([], "group_id string, observation_id string, reason string")
    first = len(store.load())
    last = plan.agg(F.max("block")).first()[0]
    ahead = written(blocks(rows, plan), f"{folder}/blocks")
    for k in range(0 if last is None else last + 1):
        block = ahead.where(F.col("block") == k).join(stopped, "group_id", "left_anti")
        if block.isEmpty():
            break
        number = first + k + 1
        tables, ended = wave(store, block, f"{folder}/{number}")
        store.commit(tables, f"{key}-{number}", dealt=True)
        if not ended.isEmpty():
            stopped = written(stopped.unionByName(ended))
        removed(spark, f"{folder}/{number}")
    failed = stopped.where("observation_id is not null")
    out = every.join(done().select(*NAME, F.lit(True).alias("_in")), NAME, "left").join(replayed.withColumn("_was", F.lit(True)), NAME, "left").join(failed, NAME, "left")
    removed(spark, folder)
    status = F.when(F.col("_was"), "REPLAYED").when(F.col("_in"), "COMMITTED").when(F.col("reason").isNotNull(), "FAILED").otherwise("WAITING")
    return out.select("group_id", "observation_id", status.alias("status"), "reason")


def stream(rows: DataFrame, store: Store, checkpoint: str, key: str, trigger: dict | None = None):
    """A streaming query that ingests each micro-batch; a batch that comes again after a failure is all replays.

    Observations of a group must arrive in their order over batches; within a batch the order is restored.
    """

    def batch(df: DataFrame, number: int) -> None:
        out = ingest(store, df, f"{key}-{number}")
        out.where("status in ('FAILED', 'WAITING')").write.mode("overwrite").parquet(f"{store.path}/failures/{key}-{number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
