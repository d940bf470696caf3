"""What the ingest leaves on disk, and that a failed observation of an earlier call keeps its place."""

import datetime as dt
import random
from pathlib import Path

from factloom.operators import ingest as I
from factloom.sources import store as S
from factloom.sources.durable import shared_folder


def test_a_text_is_not_stored_for_each_of_its_candidates(spark, tmp_path, monkeypatch):
    """100 candidates of one text of 20,000 characters: a copy of it in each, once, in every step."""
    text, n = "".join(random.Random(1).choices("0123456789abcdef", k=20_000)), 100
    rows = [("g", "o", 0, dt.datetime(2024, 1, 1), text, i, "Ann", f"f{i}", str(i), None, None, None, 0.9, f"span {i}", None, None, None) for i in range(n)]
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    monkeypatch.setattr(I, "removed", lambda *_: None, raising=False)
    before, store = size(), S.Store(spark, f"{tmp_path}/store")
    assert [r.status for r in I.ingest(store, spark.createDataFrame(rows, I.ROW).coalesce(1), "k").collect()] == ["COMMITTED"]
    assert size() - before < 20 * len(text)
    got = store.table("evidence").collect()
    assert len(got) == n + 1 and {r.source_text for r in got} == {text} and sum(r.span is None for r in got) == 1
    assert store.table("states").count() == n


def test_spans_that_repeat_or_are_the_whole_text(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    row = lambda i, field, span, text="all of it", o="o", k=0: ("g", o, k, at, text, i, "Ann", field, "x", None, None, None, 0.9, span, None, None, None)
    rows = [row(0, "a", "part"), row(1, "b", "part"), row(2, "c", "all of it"), row(3, "d", None), row(4, "e", "else", "another text")]
    store = S.Store(spark, f"{tmp_path}/store")
    I.ingest(store, spark.createDataFrame(rows, I.ROW), "k").collect()
    got = sorted((r.source_text, r.span or "") for r in store.table("evidence").collect())
    assert got == [("all of it", ""), ("all of it", "part"), ("another text", ""), ("another text", "else")]
    held = {r.evidence_id for r in store.table("evidence").collect()}
    assert all(e in held for r in store.table("states").collect() for e in r.evidence_ids)


def test_what_follows_a_failed_one_goes_in_with_it_in_later_blocks_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 2)
    at = dt.datetime(2024, 1, 1)
    row = lambda i, v, g="g": (g, f"{g}{i}", i, at + dt.timedelta(hours=i), f"t{i}", 0, "Ann", "city", v, None, None, None, 0.9, f"s{i}", None, None, None)
    store = S.Store(spark, f"{tmp_path}/store")
    status = lambda rows, key: {r.observation_id: r.status for r in I.ingest(store, spark.createDataFrame(rows, I.ROW), key).collect()}
    assert status([row(0, "a"), row(1, None), row(2, "c"), row(3, "d"), row(4, "e"), row(0, "a", "h")], "a") == {"g0": "COMMITTED", "g1": "FAILED", "g2": "WAITING", "g3": "WAITING", "g4": "WAITING", "h0": "COMMITTED"}
    assert status([row(2, "c"), row(3, "d"), row(4, "e"), row(1, "b", "h")], "b") == {"g2": "WAITING", "g3": "WAITING", "g4": "WAITING", "h1": "COMMITTED"}
    assert set(status([row(i, "abcde"[i]) for i in range(1, 5)], "c").values()) == {"COMMITTED"}
    now = {(r.group_id, r.value): r.status for r in store.table("states").collect()}
    assert now == {**{("g", v): "STALE" for v in "abcd"}, ("g", "e"): "CURRENT", ("h", "a"): "STALE", ("h", "b"): "CURRENT"}


def test_blocks(spark, monkeypatch):
    """In order, of at most so many observations and rows; one with more rows is alone."""
    monkeypatch.setattr(I, "BLOCK", 4)
    monkeypatch.setattr(I, "CANDIDATES", 10)
    sizes = [3, 3, 30, 1, 1, 1, 1, 1, 9, 4]
    rows = spark.createDataFrame([("g", f"{i:02d}", i) for i, n in enumerate(sizes) for _ in range(n)], "group_id string, observation_id string, observation_index long")
    got = {r.place: (r.observation_id, r.block, r.last) for r in I.planned(rows, rows.limit(0)).collect()}
    assert got == {i: (f"{i:02d}", b, i - 1) for i, b in enumerate([0, 0, 1, 2, 3, 3, 3, 3, 4, 5])}
