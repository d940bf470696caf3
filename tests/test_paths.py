"""Goal paths: what is left out on the way is never what the best path needs."""

import random

from factloom.operators import paths

FACT = "subject string, relation string, object string, state_id string, score double"


def best(facts, anchor, goal, hints, max_hops):
    """All paths from an anchor, one by one."""
    found, front = [], [((), (anchor,), anchor, 0, 0.0)]
    for hop in range(1, max_hops + 1):
        onward = []
        for path, seen, at, n, score in front:
            for s, r, o, i, gain in facts:
                if s == at and i not in path:
                    step = (*path, i), n + (n < len(hints) and hints[n] == r), score + gain
                    if r == goal:
                        found.append((-step[1], -step[2], hop, step[0], o))
                    elif o not in seen:
                        onward.append((step[0], (*seen, o), o, *step[1:]))
        front = onward
    return min(found, default=None)


def walked(spark, facts, anchors, hops, **kw):
    got = paths.goal_paths(spark.createDataFrame(facts, FACT), spark.createDataFrame([(a,) for a in anchors], "anchor string"), "goal", ["h", "x"], max_hops=hops, **kw).collect()
    return {r.anchor: (-r.n_hints, r.hops, tuple(r.path.split(">")), r.target) for r in got}


def test_a_worse_way_round_is_walked_on(spark):
    """The best way to v has used m, which the best path passes after v."""
    facts = [("a", "x", "m", "1", 1.0), ("m", "x", "v", "2", 2.0), ("a", "x", "n", "3", 0.5), ("n", "x", "v", "4", 0.5), ("v", "x", "m", "5", 5.0), ("m", "goal", "t", "6", 1.0)]
    for prune in (False, True):
        got = walked(spark, facts, ["a"], 4, prune=prune)
        assert got == {"a": (0, 4, ("3", "4", "5", "6"), "t")}


def test_random_walks_against_all_paths(spark):
    """Small dense graphs with facts known by one id both ways, equal scores and near ones."""
    facts, want, r = [], {}, random.Random(5)
    for g in range(60):
        n, own = r.randrange(4, 7), []
        for i in range(r.randrange(8, 22)):
            a, b = (f"{g}n{r.randrange(n)}" for _ in "ab")
            relation, score = r.choice(["x", "x", "x", "h", "y", "goal"]), r.choice([0.1, 0.2, 0.3, 1.0, r.random()])
            own.append((a, relation, b, f"{g}s{i:02d}", score))
            own += [(b, "of", a, f"{g}s{i:02d}", score)] if r.random() < 0.5 and a != b else []
        facts += own
        found = best(own, f"{g}n0", "goal", ["h", "x"], 4)
        if found:
            want[f"{g}n0"] = (found[0], *found[2:])
    for prune in (False, True):
        assert walked(spark, facts, [f"{g}n0" for g in range(60)], 4, prune=prune) == want


def test_a_hop_costs_as_the_facts_do(spark, monkeypatch):
    """100 anchors before a hub of 100 ways on, each the best for none but its own: a path for each pair, once."""
    n, sizes, real = 100, [], paths.written

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(paths, "written", counted)
    facts = [x for i in range(n) for x in ((f"a{i:02d}", "x", "hub", f"s{i:02d}", 1.0), ("hub", "x", f"a{i:02d}", f"s{i:02d}", 1.0), (f"a{i:02d}", "goal", "t", f"g{i:02d}", float(i)))]
    got = walked(spark, facts, [f"a{i:02d}" for i in range(n)], 3, prune=True)
    # over the hub to the last, and from the last to the one before it
    top = lambda i: n - 1 if i < n - 1 else n - 2
    assert got == {f"a{i:02d}": (0, 3, (f"s{i:02d}", f"s{top(i):02d}", f"g{top(i):02d}"), "t") for i in range(n)}
    assert max(sizes) <= len(facts)


def test_few_of_many_ways_are_kept(spark):
    """200 ways on from a hub: as many stay as the fact and the entity that lead to it could bar, and one more."""
    n = 200
    ways = spark.createDataFrame([("hub", 0, [f"a{i:03d}", f"b{i:03d}"], [f"m{i}"], [1.0, float(i)], 0, "t", i + 1.0) for i in range(n)], "at string, met int, path array<string>, seen array<string>, gains array<double>, n_hints int, target string, score double")
    for before, few in ((0, 1), (1, 3), (2, 5)):
        assert sorted(r.score for r in paths.thinned(ways, before, 0.0).collect()) == [n - few + 1.0 + i for i in range(few)]
    assert paths.thinned(ways.limit(0), 1, 0.0).count() == 0


def test_scores_that_are_no_numbers(spark):
    facts = [("a", "x", "m", "1", None), ("m", "goal", "t", "2", 1.0), ("a", "goal", "u", "3", float("inf"))]
    assert walked(spark, facts, ["a"], 3, prune=True) == walked(spark, facts, ["a"], 3) == {"a": (0, 2, ("1", "2"), "t")}
