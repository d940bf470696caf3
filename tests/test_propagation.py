"""The cascade against a plain level-by-level walk on random graphs, and its rules one by one."""

import random

import pytest

from factloom.operators import dependency

ACTIVE = {"CURRENT", "UNCERTAIN"}


def plainly(states, edges, seeds, protected):
    version, status = {s: v for s, v, _ in states}, {s: t for s, _, t in states}
    strict = {(version[a], version[b]) for a, b, k in edges if k == "STRICT" and a in version and b in version and version[a] != version[b]}
    sound = {(version[a], version[b]) for a, b, k in edges if k == "STRICT" and a in version and b in version and version[a] != version[b] and status[a] == "CURRENT"}
    weak = {(version[a], version[b]) for a, b, k in edges if k == "WEAK" and a in version and b in version and version[a] != version[b]}
    shut = {version[s] for s in protected if s in version}
    done = {version[s]: (0, None, version[s], True) for s in seeds if s in version}
    front = dict(done)
    depth = 0
    while front:
        depth += 1
        reached = {}
        for a, b in strict:
            if a in front and b not in done:
                via, root = reached.get(b, (a, front[a][2]))
                reached[b] = (min(via, a), min(root, front[a][2]))
        gone = set(done) | set(reached)
        new = {b: (depth, via, root, b not in shut or any(t == b and a not in gone for a, t in sound)) for b, (via, root) in reached.items()}
        done |= new
        front = {b: x for b, x in new.items() if x[3]}
    out = [(s, v, *done[v][:3], "PROTECTED" if not done[v][3] else "PASSED" if t not in ACTIVE else "SEED" if done[v][0] == 0 else "STALE") for s, v, t in states if v in done]
    for b in {b for a, b in weak if a in done and done[a][3]} - {v for v, x in done.items() if x[3]}:
        by = [a for a, t in weak if t == b and a in done and done[a][3]]
        out += [(s, v, min(done[a][0] for a in by) + 1, min(by), min(done[a][2] for a in by), "REVALIDATE") for s, v, t in states if v == b and t in ACTIVE]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 40
    states = [(f"s{i:02d}", f"v{r.randrange(30):02d}", r.choice(["CURRENT", "CURRENT", "UNCERTAIN", "STALE"])) for i in range(n)]
    pick = lambda: f"s{r.randrange(n + 2):02d}"
    edges = [(pick(), pick(), r.choice(["STRICT", "STRICT", "WEAK", "NONE"])) for _ in range(60)]
    seeds, protected = [pick() for _ in range(3)], [pick() for _ in range(10)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    got = dependency.propagate(frame(states, ["state_id", "version", "status"]), frame(edges, ["source", "target", "strength"]), frame([(s,) for s in seeds], ["state_id"]), frame([(s,) for s in protected], ["state_id"]))
    assert sorted(map(tuple, got.collect()), key=str) == plainly(states, edges, seeds, protected)


def run(spark, states, edges, seeds, protected=()):
    got = dependency.propagate(spark.createDataFrame(states, "state_id string, version string, status string"), spark.createDataFrame(edges, "source string, target string, strength string"), spark.createDataFrame([(s,) for s in seeds], "state_id string"), spark.createDataFrame([(s,) for s in protected], "state_id string"))
    return {x.state_id: (x.outcome, x.depth) for x in got.collect()}


def test_replacement_falls_only_with_independent_support(spark):
    """old -> new is the walk back into the replacement; an outside source that stands lets it go on."""
    states = [(s, s, "CURRENT") for s in ("old", "new", "next", "other")]
    edges = [("old", "new", "STRICT"), ("new", "next", "STRICT")]
    assert run(spark, states, edges, ["old"], ["new"]) == {"old": ("SEED", 0), "new": ("PROTECTED", 1)}
    edges.append(("other", "new", "STRICT"))
    assert run(spark, states, edges, ["old"], ["new"]) == {"old": ("SEED", 0), "new": ("STALE", 1), "next": ("STALE", 2)}
    states[3] = ("other", "other", "STALE")
    assert run(spark, states, edges, ["old"], ["new"])["new"] == ("PROTECTED", 1)
    states[3] = ("other", "other", "CURRENT")
    assert run(spark, states, [*edges, ("old", "other", "STRICT")], ["old"], ["new"])["new"] == ("PROTECTED", 1)


def test_inactive_states_pass_it_on_and_aliases_fall_together(spark):
    states = [("a", "a", "CURRENT"), ("b", "b", "HISTORICAL"), ("c", "c", "UNCERTAIN"), ("c2", "c", "CURRENT"), ("c3", "c", "STALE"), ("d", "d", "CURRENT")]
    edges = [("a", "b", "STRICT"), ("b", "c", "STRICT"), ("c2", "d", "WEAK"), ("c", "a", "STRICT"), ("gone", "d", "STRICT")]
    assert run(spark, states, edges, ["a"]) == {"a": ("SEED", 0), "b": ("PASSED", 1), "c": ("STALE", 2), "c2": ("STALE", 2), "c3": ("PASSED", 2), "d": ("REVALIDATE", 3)}
    assert run(spark, states, edges, []) == {}
