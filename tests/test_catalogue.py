"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import answer_queries, catalogue, grounding_queries, memory_queries, state_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    twin = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(twin.fetchall(), twin.columns)


def test_stream_equals_batch(spark, tmp_path):
    from factloom.sources import adapters
    from factloom.streaming import windows

    events = adapters.read(spark, SF, "events")
    q = windows.stream_tumbling(spark, SF, events.schema, str(tmp_path / "out"), str(tmp_path / "cp"), glob="events.parquet")
    q.awaitTermination()
    got = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = windows.tumbling(events.withColumn("ts", events.ts.cast("timestamp"))).collect()
    want = {(r.window_start, r.event_type): r.n for r in batch}
    assert got and all(want[k] == n for k, n in got.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
