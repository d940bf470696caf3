"""Dependency candidates and the fill of retrievals against plain versions."""

import random

import pytest

from factloom.operators import discovery, filling, selectors

STATE = "group_id string, state_id string, entity string, attribute string, value string, status string, span string, evidence_ids array<string>, depends array<struct<entity:string,attribute:string,value:string,relation_type:string>>, observation_index long, sequence_index long, version_id string"


def state(s, e, a, v, span, evidence=(), depends=None, status="CURRENT", g="g"):
    return (g, s, e, a, v, status, span, list(evidence) or [s], depends or [], 0, 0, f"v{s}")


def pairs(spark, states, new):
    df = spark.createDataFrame(states, STATE)
    return {(r.prerequisite, r.dependent): (r.signals, r.proposed, r.reason) for r in discovery.candidates(df.where(df.state_id.isin(list(new))), df).collect()}


@pytest.mark.parametrize("n, others", [(5, 30), (10, 80)])
def test_candidates_stay_sparse(spark, n, others):
    states = [x for i in range(n) for x in (state(f"source-{i}", f"user-{i}", "available", "Tuesday", f"User {i} is available Tuesday."), state(f"target-{i}", f"visit-{i}", "feasible", "Tuesday", f"Visit {i} is feasible because user-{i} is available Tuesday."))]
    states += [state(f"unrelated-{i}", f"fact-{i}", "property", f"value-{i}", f"Fact {i} has value {i}.") for i in range(others)]
    got = pairs(spark, states, [s[1] for s in states if not s[1].startswith("source")])
    assert set(got) == {(f"source-{i}", f"target-{i}") for i in range(n)}
    assert all(x[0] == ["causal_text_grounding", "explicit_source_relation"] for x in got.values())


def test_sources_of_signals(spark):
    states = [
        state("a", "Ann Lee", "city", "Rome", "Ann Lee lives in Rome", ["e1"]), state("b", "Bob", "city", "Oslo", "x", ["e2"]), state("h", "Ann Lee", "city", "Ulm", "x", status="STALE", g="h"),
        state("c", "trip", "plan", "go", "reserved for ann lee after the visit, because it is due to her", ["e1", "e3"], [("ann lee", None, None, "depends-on"), (None, "CITY", None, "derived-from"), (None, None, "go", "depends-on")]),
        state("d", "note", "plan", "go", "it requires Bobby and b.o.b", ["e3"], [("bob", "city", None, "affects-action")]), state("z", "zed", "a", "b", "because Bob", status="STALE"),
    ]
    got = pairs(spark, states, ["c", "d", "z"])
    assert got == {
        ("a", "c"): (["causal_text_grounding", "execution_provenance", "explicit_semantic_relation", "explicit_source_relation", "used_by_relation"], "depends-on", "stated"),
        ("b", "d"): (["action_precondition", "explicit_semantic_relation"], "affects-action", "stated"),
        ("c", "d"): (["execution_provenance"], None, "shared evidence"),
        ("d", "c"): (["execution_provenance", "explicit_semantic_relation", "used_by_relation"], "depends-on", "stated"),
    }


def test_nearby_pairs(spark):
    r = random.Random(1)
    located = [("g", f"t{r.randrange(3)}", f"s{i:03d}", r.randrange(40)) for i in range(120)]
    df = spark.createDataFrame([(*x, 10 * x[3], 10 * x[3] + 9) for x in located], "group_id string, text_id string, state_id string, sentence int, sentence_start int, sentence_end int")
    new = {x[2] for x in located if r.random() < 0.5}
    got = sorted((x.text_id, x.prerequisite, x.dependent, x.window_start, x.window_end) for x in discovery.nearby(df.where(df.state_id.isin(list(new))), df).collect())
    want = sorted((t, a, b, 10 * min(i, j), 10 * max(i, j) + 9) for _, t, a, i in located for _, u, b, j in located if t == u and a != b and b in new and abs(i - j) <= 2)
    assert got == want


def test_selectors_hit_one_version(spark):
    rows = [("g", "1", "v1", "Ann", "city", "Rome", 1, 0), ("g", "2", "v1", "ann", "city", "rome", 0, 0), ("g", "3", "v2", "Bob", "city", "Rome", 0, 0), ("h", "4", "v4", "Ann", "city", "Rome", 0, 0)]
    states = spark.createDataFrame(rows, "group_id string, state_id string, version_id string, entity string, attribute string, value string, observation_index long, sequence_index long")
    asked = [("g", " ANN ", None, None), ("g", None, "city", None), ("g", "bob", "City", "rome"), ("g", "zed", None, None), ("g", None, None, None), ("h", None, None, None), ("x", None, None, None), ("g", None, None, "ROME ")]
    sel = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, group_id string, sel_entity string, sel_attribute string, sel_value string")
    got = {r.n: (r.found, r.n_versions, r.state_id) for r in selectors.exactly_one(sel, states).collect()}
    assert got == {0: ("ONE", 1, "2"), 1: ("SEVERAL", 2, None), 2: ("ONE", 1, "3"), 3: ("NONE", 0, None), 4: ("SEVERAL", 2, None), 5: ("ONE", 1, "4"), 6: ("NONE", 0, None), 7: ("SEVERAL", 2, None)}
    assert sorted((r.n, r.state_id) for r in selectors.matches(sel, states).where("n in (0, 5, 6)").collect()) == [(0, "1"), (0, "2"), (5, "4")]
    own = sel.selectExpr("*", "'v2' as own", "'Bob' as own_entity", "'city' as own_attribute", "'Rome' as own_value")
    got = {r.n: (r.found, r.state_id) for r in selectors.exactly_one(own.where("group_id = 'g'"), states, own="own").collect()}
    assert got == {0: ("ONE", "2"), 1: ("ONE", "2"), 2: ("NONE", None), 3: ("NONE", None), 4: ("ONE", "2"), 7: ("ONE", "2")}


def plain_fill(ranked, edges, limit, depth, beam):
    out = {}
    for q in {r[0] for r in ranked}:
        mine = {s: (rank, relevant, intent, prov) for qq, s, rank, relevant, intent, prov in ranked if qq == q}
        adj = {}
        for a, b, t in edges:
            if a in mine and b in mine:
                adj.setdefault(a, []).append((t != "depends-on", mine[b][0], b, t))
                adj.setdefault(b, []).append((t != "depends-on", mine[a][0], a, t))
        chosen = []
        cover = sorted((s for s in mine if mine[s][2] is not None), key=lambda s: (mine[s][2], mine[s][0]))
        side = sorted((s for s in mine if mine[s][2] is None and mine[s][3]), key=lambda s: mine[s][0])
        rest = sorted((s for s in mine if mine[s][2] is None and not mine[s][3] and mine[s][1]), key=lambda s: mine[s][0])
        for s in [*cover, *side]:
            if len(chosen) < limit:
                chosen.append(s)

        def expand(s):
            level = [s]
            for _ in range(depth):
                following = []
                for x in level:
                    seen, got = set(), []
                    for _, _, n, _ in sorted(adj.get(x, [])):
                        if n not in chosen and n not in seen:
                            seen.add(n)
                            got.append(n)
                    for n in got[:beam]:
                        if len(chosen) < limit:
                            chosen.append(n)
                            following.append(n)
                level = following

        for s in cover:
            expand(s)
        for s in [*side, *rest]:
            if s not in chosen and len(chosen) < limit:
                chosen.append(s)
                expand(s)
        out[q] = chosen
    return out


@pytest.mark.parametrize("limit, depth, beam", [(10, 2, 4), (6, 3, 1), (4, 1, 2)])
def test_fill_against_a_plain_walk(spark, limit, depth, beam):
    r = random.Random(limit)
    states = [f"s{i:02d}" for i in range(60)]
    ranked = []
    for q in range(6):
        own = r.sample(states, 50)
        for rank, s in enumerate(own, 1):
            ranked.append((q, s, rank, r.random() < 0.4, r.choice([0, 1]) if r.random() < 0.06 else None, r.random() < 0.05))
    edges = [(r.choice(states), r.choice(states), r.choice(["depends-on", "derived-from"])) for _ in range(90)] + [("s00", s, "depends-on") for s in states[1:]]  # a hub
    edges = [(a, b, t) for a, b, t in edges if a != b]
    got = filling.fill(spark.createDataFrame(ranked, "question_id int, state_id string, rank int, relevant boolean, intent int, provenance boolean"), spark.createDataFrame(edges, "source string, target string, relation_type string"), limit, depth, beam)
    by = {}
    for x in got.collect():
        by.setdefault(x.question_id, []).append((x.place, x.state_id))
    assert {q: [s for _, s in sorted(v)] for q, v in by.items()} == plain_fill(ranked, edges, limit, depth, beam)


def test_coverage(spark):
    rows = [(1, "a", 0, 0.5), (1, "b", 0, 0.5), (1, "c", 0, 0.2), (1, "a", 1, 0.9), (1, "c", 1, 0.4), (1, "d", 1, 0.0), (2, "a", 1, 0.1), (2, "b", 0, 0.0)]
    got = filling.coverage(spark.createDataFrame(rows, "question_id int, state_id string, intent int, overlap double")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0), (1, "b", 0), (1, "c", 1), (2, "a", 1)]
    assert filling.coverage(spark.createDataFrame([], "question_id int, state_id string, intent int, overlap double")).collect() == []
