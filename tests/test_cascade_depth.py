"""What a review found missing in the graph operators."""

import pytest

from factloom.operators import graph


def test_cascade_has_no_depth_limit(spark):
    edges = spark.createDataFrame([*((i, i + 1) for i in range(53)), (53, 20)], "source long, target long").cache()
    seeds = spark.createDataFrame([(0,)], "node long")
    assert sorted(tuple(r) for r in graph.cascade(edges, seeds).collect()) == [(i, i) for i in range(54)]
    with pytest.raises(RuntimeError):
        graph.cascade(edges, seeds, 3)
    assert graph.cascade(edges.where("source < 3"), seeds, 3).count() == 4


def test_deep_cascades_take_few_rounds_and_stop_where_asked(spark, monkeypatch):
    n, sizes = 300, []
    real = graph.written

    def counted(df):
        sizes.append(1)
        return real(df)

    monkeypatch.setattr(graph, "written", counted)
    # a ring with two ways in, and a repeated edge; node 10 is a seed and 10 deep as well
    ring = [*((i, (i + 1) % n) for i in range(n)), (0, 1), (1000, 5), (1001, 1000)]
    edges = spark.createDataFrame(ring, "source long, target long").cache()
    seeds = spark.createDataFrame([(0,), (10,), (1001,)], "node long")

    def walk(within=None):
        depth, front, k = dict.fromkeys((0, 10, 1001), 0), {0, 10, 1001}, 0
        while front and (within is None or k < within):
            k += 1
            front = {t for s, t in ring if s in front} - set(depth)
            depth |= dict.fromkeys(front, k)
        return depth

    assert dict(graph.cascade(edges, seeds).collect()) == walk()
    assert len(sizes) < 50
    for within in (0, 13, 200):
        got = graph.cascade(edges, seeds, within=within).collect()
        assert dict(got) == walk(within) and len(got) == len(walk(within))
    with pytest.raises(RuntimeError):
        graph.cascade(edges, seeds, 280)
    # a source with two targets is walked level by level
    two = spark.createDataFrame([*((i, i + 1) for i in range(30)), (14, 20)], "source long, target long")
    got = dict(graph.cascade(two, spark.createDataFrame([(0,)], "node long")).collect())
    assert got == {i: i if i < 20 else min(i, i - 5) for i in range(31)}
