"""Steps whose rows, joins or estimates once grew faster than their input."""

from collections import Counter

from factloom.operators import evaluation, graph, linking, paths
from factloom.sources.durable import cut


def test_answers_are_scored_without_broadcasts_also_with_repeated_keys(spark):
    said = [(1, "a b b c", "b b b c d"), (2, "x", "y"), (3, "", "the"), (4, "b b q", "b"), (4, "b", "b b r"), (None, "z", "z")]
    got = evaluation.answer_f1(spark.createDataFrame(said, "k int, p string, r string"), ["k"], "p", "r")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    words = lambda t: [w for w in t.split() if w not in ("a", "an", "the")]

    def f1(k, p, r):
        # rows of one key count together
        a, b = (Counter(w for row in said if row[0] == k for w in words(row[i])) for i in (1, 2))
        p, r, tp = words(p), words(r), (a & b).total() if k else (Counter(words(p)) & Counter(words(r))).total()
        return float(p == r) if not p or not r else round(2 * tp / (len(p) + len(r)), 6)

    assert sorted(x.f1 for x in got.collect()) == sorted(f1(*row) for row in said)


def test_a_hub_without_a_way_to_the_goal_is_not_walked(spark, monkeypatch):
    n, sizes = 60, []

    def counted(df):
        sizes.append(df.count())
        return cut(df)

    monkeypatch.setattr(paths, "written", counted)
    facts = [(f"a{i}", "in", f"m{i}", f"i{i}", 1.0) for i in range(n)] + [(f"m{i}", "near", "hub", f"h{i}", 1.0) for i in range(n)]
    facts += [("hub", "of", f"x{i}", f"o{i}", 1.0) for i in range(n)] + [(f"m{i}", "goal", "end", f"g{i}", 1.0) for i in range(0, n, 2)]
    got = paths.goal_paths(spark.createDataFrame(facts, "subject string, relation string, object string, state_id string, score double"), spark.createDataFrame([(f"a{i}",) for i in range(n)], "anchor string"), "goal", max_hops=3)
    assert {(r.anchor, r.path, r.hops) for r in got.collect()} == {(f"a{i}", f"i{i}>g{i}", 2) for i in range(0, n, 2)}
    # not one row for each pair of an anchor and a leaf of the hub
    assert max(sizes) <= len(facts)


def bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_of_loops_stay_in_bounds(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "source long, target long")
    label = graph.components(chain)
    assert bits(label) < 64
    assert {tuple(r) for r in label.collect()} == {(i, 0) for i in range(n + 1)}
    assert bits(linking.roots(chain.select(chain.source.alias("state"), chain.target.alias("parent")))) < 200
    assert bits(graph.cascade(chain.where("source < 20"), spark.createDataFrame([(0,)], "node long"))) < 64


def test_components_of_a_shuffled_chain_take_few_rounds(spark, monkeypatch):
    n, sizes = 600, []
    real = graph.written

    def counted(df):
        sizes.append(1)
        return real(df)

    monkeypatch.setattr(graph, "written", counted)
    at = [i * 233 % n for i in range(n)]
    label = graph.components(spark.createDataFrame(list(zip(at, at[1:], strict=False)), "source long, target long"))
    assert {tuple(r) for r in label.collect()} == {(i, 0) for i in range(n)}
    assert len(sizes) <= 12


def test_state_pairs_are_not_gathered(spark):
    """One shuffle, of narrow rows: pairs once went through an aggregate by all of their columns."""
    from factloom.sources import adapters

    pairs = adapters.state_pairs(adapters.full_states(spark, "/root/testdata/sf0.001"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    ids = [(r.n_state_id, r.o_state_id) for r in pairs.select("n_state_id", "o_state_id").collect()]
    assert ids and len(ids) == len(set(ids))


ATTRIBUTES = ["home", "Home", "home_city", "city", "city of", "of", "of ", "the", "job", "occupation", "current_job", "current job", "free_on", "availability", "", " ", "-", "home city-name", "name", "used_tool", "tool"]


def test_compatible_attributes_share_a_key(spark):
    from pyspark.sql import functions as F

    from factloom.functions import identity

    a = spark.createDataFrame([(x,) for x in [*ATTRIBUTES, None]], "a string")
    pairs = a.crossJoin(a.withColumnRenamed("a", "b"))
    keys = lambda c: identity.attribute_keys(identity.attribute_parts(F.col(c)))
    got = pairs.select(identity.attributes_compatible(F.col("a"), F.col("b")).alias("yes"), F.arrays_overlap(keys("a"), keys("b")).alias("meet")).collect()
    assert all(r.meet for r in got if r.yes) and any(not r.meet for r in got)


def test_overrides_meet_by_attribute_and_compare_no_texts_in_pairs(spark):
    from pyspark.sql import functions as F

    from factloom.functions import identity
    from factloom.operators import conflict, shadowing

    day = lambda i: f"timestamp_ntz'2024-01-{i:02d}'"
    rows = [(i, "ann", a, str(i % 3), i % 9 + 1, i % 9 + 1 + i % 4) for i, a in enumerate(ATTRIBUTES * 3)]
    s = spark.createDataFrame(rows, "state_id long, entity string, attribute string, value string, x int, y int")
    at = lambda c: F.when(F.col(c) % 5 != 0, F.expr(day(1)) + F.make_dt_interval(days=F.col(c)))
    cond = F.when(F.col("x") % 3 == 0, F.array(F.struct(F.lit("m").alias("key"), F.col("value").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    s = s.select("state_id", "entity", "attribute", "value", at("x").alias("t0"), at("y").alias("t1"), cond.alias("cond")).cache()
    got = conflict.suppressed(s, ["1"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(join) == 1 and "key#" in join[0] and "regexp" not in join[0]
    # the pairs one by one, by the rules themselves
    from factloom.functions import scope

    b, n = s.alias("b"), s.alias("n")
    c = lambda p, x: F.col(f"{p}.{x}")
    told = scope.more_specific(c("n", "cond"), c("b", "cond")) & ~F.exists(c("n", "cond"), lambda x: x["value"] != "1")
    inside = scope.contains(c("b", "t0"), c("b", "t1"), c("n", "t0"), c("n", "t1")) & ~(c("b", "t0").eqNullSafe(c("n", "t0")) & c("b", "t1").eqNullSafe(c("n", "t1")))
    every = b.crossJoin(n).where((c("b", "value") != c("n", "value")) & (told | inside) & identity.attributes_compatible(c("b", "attribute"), c("n", "attribute")))
    want = every.groupBy(c("b", "state_id")).agg(F.min(c("n", "state_id"))).collect()
    assert want and {tuple(r) for r in got.collect()} == {tuple(r) for r in want}
    said = s.select("state_id", "entity", "attribute", F.lit(None).cast("string").alias("field"), "value", F.lit("x").alias("span"), F.lit("o").alias("observation_id"), F.col("state_id").alias("sequence_index"), F.expr(day(1)).alias("observed_at"), "t0", "t1", F.lit("CURRENT").alias("status"))
    plan = shadowing.shadowed(said, "still there?")._jdf.queryExecution().optimizedPlan().toString()
    join = [line for line in plan.splitlines() if "Join LeftSemi" in line]
    assert len(join) == 1 and "regexp" not in join[0]


def test_no_task_holds_a_whole_question(spark):
    """States of a question are sorted by a struct and cut before they meet; they were once numbered in one task."""
    from factloom.operators import filling
    from factloom.plans import memory_queries  # noqa: F401
    from factloom.plans.catalogue import QUERIES

    seen = []
    real = filling.fill

    def looked_at(ranked, edges, *more):
        seen.append(ranked._jdf.queryExecution().executedPlan().toString())
        return ranked.limit(0)

    filling.fill = looked_at
    try:
        QUERIES["ranked_fill"](spark, "/root/testdata/sf0.001")
    finally:
        filling.fill = real
    assert len(seen) == 1 and "Window" not in seen[0]
