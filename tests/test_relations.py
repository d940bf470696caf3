"""Canonical facts, walks through hubs, components and consolidation."""

import datetime as dt
import random

from factloom.operators import consolidation, graph, paths, relations

ROW = "entity string, attribute string, value string, state_id string, score double"


def test_forms(spark):
    rows = [("Ann", "wrote", "Book X"), ("The author of  Book X", "is", "Ann"), ("Book X", "Written-By", "ANN"), ("Zoe", "wife", "Bob"), ("Bob", "married to", "Zoe"), ("the wife of Bob", "spouse", "zoe"), ("Ann", "likes", "tea"), ("the author of Z", "likes", "tea"), ("X", "ceo", " "), ("Y", "ceo", None), ("the colour of sky", "is", "blue"), ("Acme", "employs", "Ann")]
    df = spark.createDataFrame([(*x, str(i), float(i)) for i, x in enumerate(rows)], ROW)
    got = {r.state_id: (r.subject, r.relation, r.object, r.form) for r in relations.projected(df).collect()}
    assert got["0"] == ("Book X", "author", "Ann", "inverse") and got["1"] == ("Book X", "author", "Ann", "relational") and got["2"] == ("Book X", "author", "ANN", "direct")
    assert got["3"] == got["4"] == ("Bob", "spouse", "Zoe", "symmetric") and got["5"] == ("Bob", "spouse", "zoe", "relational")
    assert [got[str(i)][3] for i in (6, 7, 8, 9, 10)] == ["unknown"] * 5 and got["11"] == ("Ann", "employer", "Acme", "inverse")
    one = {(r.subject, r.relation, r.object): (r.state_id, r.score, r.n_forms) for r in relations.merged(relations.projected(df).where("form <> 'unknown'")).collect()}
    assert one == {("Book X", "author", "Ann"): ("0", 2.0, 3), ("Bob", "spouse", "Zoe"): ("3", 5.0, 3), ("Ann", "employer", "Acme"): ("11", 11.0, 1)}
    ask = relations.anchors_of(spark.createDataFrame([(1, "The  Author of Book X"), (2, "Ann"), (3, "the colour of sky")], "id int, phrase string")).collect()
    assert [(r.anchor, r.relation) for r in ask] == [("book x", "author"), ("ann", None), ("the colour of sky", None)]


def test_a_hub_does_not_multiply_paths(spark):
    """60 roads from a to the hub and 60 on from it: one best path is walked on, and the answer is that of all paths."""
    r = random.Random(1)
    facts = [("a", "x", f"m{i}", f"a{i:02d}", r.random()) for i in range(60)] + [(f"m{i}", "x", "hub", f"b{i:02d}", r.random()) for i in range(60)] + [("hub", "goal" if i % 2 else "x", f"t{i}", f"c{i:02d}", r.random()) for i in range(60)]
    df = spark.createDataFrame(facts, "subject string, relation string, object string, state_id string, score double")
    anchor = spark.createDataFrame([("a",)], "anchor string")
    whole = paths.goal_paths(df, anchor, "goal", max_hops=3).collect()
    pruned = paths.goal_paths(df, anchor, "goal", max_hops=3, prune=True).collect()
    assert whole == pruned and whole[0].hops == 3


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 530)] + [(r.randrange(600, 700), r.randrange(600, 700)) for _ in range(60)] + [(9, 9)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(120):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {x.node: x.label for x in graph.components(spark.createDataFrame(edges, "source int, target int")).collect()} == root
    assert graph.components(spark.createDataFrame([], "source int, target int")).collect() == []


def test_consolidation_in_any_order(spark):
    t = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    a, b = [("m", "a")], [("m", "b")]
    rows = [
        ("1", 3, "Ann", "city", "Rome", 0, 5, [], 0.5, ["x"]), ("2", 1, " ann ", "City", "ROME", 4, 9, a, 0.9, ["y"]), ("3", 2, "Ann", "city", "rome", 8, None, b, 0.1, ["x", "z"]), ("4", 0, "Ann", "city", "Rome", 20, 21, b, 0.2, ["w"]),
        ("5", 5, "Ann", "city", "Rome", 6, 7, b, 0.3, ["v"]), ("6", 6, "Ann", "city", "Oslo", 0, 5, [], 0.4, ["u"]), ("7", 7, "Ann", "city", "Oslo", 5, 6, [], 0.4, ["t"]),
    ]
    schema = "candidate_id string, sequence_index long, entity string, attribute string, value string, t0 timestamp_ntz, t1 timestamp_ntz, cond array<struct<key:string,value:string>>, confidence double, evidence_ids array<string>, group_id string, observation_id string, observed_at timestamp_ntz"
    full = [(*x[:5], t(x[5]), t(x[6]), *x[7:], "g", "o", t(-1)) for x in rows]
    want = {("2", t(0), t(9), (), 0.9, ("x", "y"), 2), ("4", t(8), None, (("m", "b"),), 0.2, ("w", "x", "z"), 2), ("5", t(6), t(7), (("m", "b"),), 0.3, ("v",), 1), ("6", t(0), t(5), (), 0.4, ("u",), 1), ("7", t(5), t(6), (), 0.4, ("t",), 1)}
    for seed in range(2):
        random.Random(seed).shuffle(full)
        got = consolidation.consolidated(spark.createDataFrame(full, schema).repartition(3)).collect()
        assert {(r.candidate_id, r.t0, r.t1, tuple(map(tuple, r.cond)), r.confidence, tuple(r.evidence_ids), r.n_merged) for r in got} == want
