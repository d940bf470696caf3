"""Ingest in order: waves and streams against a plain fold, transactions, replays, the store's log."""

import datetime as dt
import json
import random

import pytest

from factloom.operators import ingest as I
from factloom.sources import store as S


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)


def row(g, i, e=None, a=None, v=None, seq=0, conf=0.9, effects=None, depends=None, t0=None, t1=None, cond=None, span=None):
    return (g, f"{g}-{i}", i, at(i), f"text {g} {i}", seq, e, a, v, t0, t1, cond, conf, span or (f"{e} {a} {v} {g} {i} {seq}" if e else None), effects, None, depends)


def frame(spark, rows):
    return spark.createDataFrame(rows, I.ROW)


def plainly(rows):
    """States (group, entity, attribute, value, index, sequence) -> (status, n_evidence), and observations -> status; no scopes or conditions."""
    states, edges, outcome = {}, [], {}
    by_group = {}
    for r in rows:
        by_group.setdefault(r[0], {}).setdefault((r[2], r[1]), []).append(r)
    for g, observations in by_group.items():
        broken = False
        for (i, o), cands in sorted(observations.items()):
            if broken:
                outcome[o] = "WAITING"
                continue
            own = {k: dict(s) for k, s in states.items() if k[0] == g}
            before = {k: dict(s) for k, s in own.items()}
            active = {k: s for k, s in before.items() if s["status"] in ("CURRENT", "UNCERTAIN")}
            cands = sorted((c for c in cands if c[6] or c[7] or c[8]), key=lambda c: c[5])
            if any(not (c[6] or "").strip() or not (c[7] or "").strip() or c[8] is None for c in cands):
                outcome[o], broken = "FAILED", True
                continue
            once = {}
            for c in cands:
                once.setdefault((c[6].lower(), c[7], c[8].lower()), []).append(c)
            seeds, replacing, new = set(), set(), []
            for same in once.values():
                c, conf = same[0], max(x[12] for x in same)
                olds = [k for k in active if k[1].lower() == c[6].lower() and k[2] == c[7]]
                twins = [k for k in olds if k[3].lower() == c[8].lower() and active[k]["status"] == "CURRENT"]
                if twins:
                    k = min(twins, key=lambda k: (k[4], k[5]))
                    own[k]["evidence"] = own[k]["evidence"] | {c[13]}
                    continue
                updates = [k for k in olds if k[3].lower() != c[8].lower()]
                me = (g, c[6], c[7], c[8], i, c[5])
                own[me] = {"status": "CURRENT" if updates or conf >= 0.5 else "UNCERTAIN", "evidence": {c[13]}}
                fell = [k for k in updates if active[k]["status"] == "CURRENT"]
                seeds |= set(fell)
                if fell:
                    replacing.add(me)
                new.append((me, c))
            for k in seeds:
                own[k]["status"] = "STALE"
            mine = []
            for me, c in new:
                for e, a, v, strength in c[16] or []:
                    if own[me]["status"] == "CURRENT":
                        hits = [k for k, s in own.items() if k != me and s["status"] == "CURRENT" and all(x is None or x.lower() == y.lower() for x, y in zip((e, a, v), k[1:4]))]
                        if len(hits) == 1:
                            mine.append((hits[0], me, strength))
            strict = [(a, b) for a, b, s in edges + mine if s == "STRICT" and a[0] == g]
            front, done = set(seeds), set(seeds)
            while front:
                reached = {b for a, b in strict if a in front} - done
                done |= reached
                front = {b for b in reached if b not in replacing or any(y == b and x not in done and own[x]["status"] == "CURRENT" for x, y in strict)}
                for b in front:
                    if own[b]["status"] in ("CURRENT", "UNCERTAIN"):
                        own[b]["status"] = "STALE"
            live = [(k[1].lower(), k[2], k[3].lower()) for k, s in own.items() if s["status"] in ("CURRENT", "UNCERTAIN")]
            if len(live) != len(set(live)):
                outcome[o], broken = "FAILED", True
                continue
            states.update(own)
            edges += mine
            outcome[o] = "COMMITTED"
    return {k: (s["status"], len(s["evidence"])) for k, s in states.items()}, outcome


def held(store):
    return {(r.group_id, r.entity, r.attribute, r.value, r.observation_index, r.sequence_index): (r.status, len(r.evidence_ids)) for r in store.table("states").collect()}


def some(seed, groups=6, turns=4):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        for i in range(turns):
            n = r.randrange(4)
            rows += [row(f"g{g}", i)] if not n else []
            for q in range(n):
                e, a = r.choice(["Ann", "bob"]), r.choice(["city", "role", "tool"])
                depends = [(r.choice([e, None]), r.choice(["city", "role"]), None, "STRICT")] if r.random() < 0.5 else None
                rows.append(row(f"g{g}", i, e, a, r.choice("xyz") if r.random() > 0.02 else None, q, r.choice([0.9, 0.9, 0.9, 0.2]), depends=depends))
    return rows


def test_waves_against_a_plain_fold(spark, tmp_path):
    rows = some(1, groups=8, turns=3) + [row("w", 0, "Ann", "city", "Rome"), row("w", 1, "Ann", "city"), row("w", 2, "Ann", "city", "Ulm")]
    store = S.Store(spark, f"{tmp_path}/store")
    out = {r.observation_id: r.status for r in I.ingest(store, frame(spark, rows).repartition(3), "k").collect()}
    states, outcome = plainly(rows)
    assert out == outcome and {"COMMITTED", "FAILED", "WAITING"} <= set(out.values())
    assert held(store) == states and len({s for s, _ in states.values()}) > 2
    log = store.load(verify=True)
    again = {r.observation_id: r.status for r in I.ingest(store, frame(spark, [x for x in rows if outcome[x[1]] == "COMMITTED"]), "again").collect()}
    assert set(again.values()) == {"REPLAYED"} and store.load() == log and held(store) == states


def test_stream_equals_batch(spark, tmp_path):
    rows = some(2, groups=3, turns=2)
    for k in range(2):
        frame(spark, [r for r in rows if r[2] == k]).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    store = S.Store(spark, f"{tmp_path}/store")
    for k in range(2):  # a file at a time, as it arrives
        source = spark.readStream.schema(frame(spark, rows[:1]).schema).parquet(f"{tmp_path}/in/part{k}")
        q = I.stream(source, store, f"{tmp_path}/cp{k}", f"s{k}")
        q.awaitTermination()
        assert q.exception() is None
    assert held(store) == plainly(rows)[0]


def test_a_failure_leaves_the_group_as_it_was(spark, tmp_path):
    store = S.Store(spark, f"{tmp_path}/store")
    I.ingest(store, frame(spark, [row("g", 0, "Ann", "city", "Rome"), row("h", 0, "Ann", "city", "Rome")]), "a").collect()
    before = held(store)
    bad = [row("g", 1, "Ann", "city", "Bonn"), row("g", 1, "Ann", " ", "x", 1), row("h", 1, "Ann", "city", "Oslo"), row("h", 2, "Ann", "city", "Oslo", t0=at(5), t1=at(3))]
    out = {r.observation_id: (r.status, r.reason) for r in I.ingest(store, frame(spark, bad), "b").collect()}
    assert out == {"g-1": ("FAILED", "INCOMPLETE_CANDIDATE"), "h-1": ("COMMITTED", None), "h-2": ("FAILED", "INVERTED_VALIDITY")}
    now = held(store)
    assert {k: v for k, v in now.items() if k[0] == "g"} == {k: v for k, v in before.items() if k[0] == "g"}
    assert {r.observation_id for r in store.table("observations").where("status = 'COMMITTED'").collect()} == {"g-0", "h-0", "h-1"}
    assert not [r for r in store.table("evidence").collect() if r.observation_id in ("g-1", "h-2")]
    # what follows waits until the failed one, mended, goes in; an order that goes back is refused
    status = lambda rows, key: {r.observation_id: (r.status, r.reason) for r in I.ingest(store, frame(spark, rows), key).collect()}
    after = row("g", 2, "Ann", "city", "Ulm")
    assert status([after], "c") == {"g-2": ("WAITING", None)}
    assert status([bad[0], after], "d") == {"g-1": ("COMMITTED", None), "g-2": ("COMMITTED", None)}
    assert status([("g", "late", 0, at(0), "t", 0, "Ann", "city", "Ulm", None, None, None, 0.9, "s", None, None, None)], "e") == {"late": ("FAILED", "ORDER_GOES_BACK")}
    assert status([row("g", 3)], "f") == {"g-3": ("COMMITTED", None)}


def test_effects_scopes_and_conditions(spark, tmp_path):
    store = S.Store(spark, f"{tmp_path}/store")
    home, away = [("mode", "home")], [("mode", "away")]
    rows = [
        row("g", 0, "Ann", "city", "Rome"), row("g", 0, "Ann", "coat", "red", 1, cond=home), row("g", 0, "Ann", "coat", "red", 2, cond=away), row("g", 0, "Zoe", "pass", "yes", 3),
        row("g", 1, "Ann", "job", "none", effects=[("Zoe", "pass", None)]), row("g", 2, "Ann", "coat", "blue", cond=away),
    ]
    out = I.ingest(store, frame(spark, rows), "k").collect()
    assert {r.status for r in out} == {"COMMITTED"}
    got = {(r.entity, r.attribute, r.value, r.sequence_index): r.status for r in store.table("states").collect()}
    assert got[("Zoe", "pass", "yes", 3)] == "STALE" and got[("Ann", "coat", "red", 1)] == "CURRENT" and got[("Ann", "coat", "red", 2)] == "STALE" and got[("Ann", "city", "Rome", 0)] == "CURRENT"
    assert [(r.relation_type, r.reason) for r in store.table("relations").collect() if "implicit" in r.reason] == [("invalidates", "implicit_invalidation")]


def state(g, s, v, status="CURRENT"):
    return (g, s, f"v{s}", "slot", "e", "a", v, status, None, False, None, None, [], 0.9, at(0), "o", 0, 0, "span", ["x"], None)


def test_commits(spark, tmp_path):
    path = f"{tmp_path}/store"
    store = S.Store(spark, path)
    of = lambda rows: {"states": spark.createDataFrame(rows, S.TABLES["states"][0])}
    assert store.load() == [] and store.table("states").count() == 0
    assert store.commit(of([state("g", "1", "a"), state("h", "2", "b")]), "one") == 1
    assert store.commit(of([state("g", "1", "a", "STALE")]), "two") == 2
    # the same key again: a no-op with the same rows, an error with others
    assert store.commit(of([state("h", "2", "b"), state("g", "1", "a")]), "one") == 1 and len(store.load()) == 2
    with pytest.raises(S.Conflict):
        store.commit(of([state("g", "1", "z")]), "one")
    # a torn write is never read
    spark.createDataFrame([state("g", "9", "torn")], S.TABLES["states"][0]).write.parquet(f"{path}/data/states/{'0' * 32}")
    want = {("g", "1", "STALE"), ("h", "2", "CURRENT")}
    now = lambda s: {(r.group_id, r.state_id, r.status) for r in s.table("states").collect()}
    assert now(store) == want
    # two writers of one number
    text = (tmp_path / "store/commits/000000000002.json").read_text()
    with pytest.raises(S.Conflict):
        store._put("commits/000000000002.json", text)
    store.export(f"{tmp_path}/snap")
    back = S.Store.restore(spark, f"{tmp_path}/snap", f"{tmp_path}/copy")
    assert now(back) == want
    assert store.compact() == 3 and now(store) == want
    assert store.clear_groups(spark.createDataFrame([("g",)], "group_id string"), "clear") == 4 and now(store) == {("h", "2", "CURRENT")}
    assert store.states(statuses=["STALE"]).count() == 0 and store.relations().count() == 0
    # fails closed: other rows, a parent that doesn't match, a gap
    path_of = json.loads(text)["tables"]["states"]["path"]
    spark.createDataFrame([state("g", "1", "other")], S.TABLES["states"][0]).write.mode("overwrite").parquet(f"{path}/{path_of}")
    with pytest.raises(S.StoreError, match="isn't what was written"):
        store.load(verify=True)
    (tmp_path / "store/commits/.000000000002.json.crc").unlink(missing_ok=True)
    (tmp_path / "store/commits/000000000002.json").write_text(text.replace('"two"', '"TWO"'))
    with pytest.raises(S.StoreError, match="doesn't follow"):
        store.load()
    (tmp_path / "store/commits/000000000002.json").unlink()
    with pytest.raises(S.StoreError, match="goes from 1"):
        store.load()


def test_damaged_snapshots(spark, tmp_path):
    store = S.Store(spark, f"{tmp_path}/store")
    store.commit({"states": spark.createDataFrame([state("g", "1", "a"), state("g", "2", "b")], S.TABLES["states"][0])}, "one")
    store.export(f"{tmp_path}/snap")
    kept = spark.read.parquet(f"{tmp_path}/snap/states").collect()
    spark.createDataFrame(kept[:1]).write.mode("overwrite").parquet(f"{tmp_path}/snap/states")
    with pytest.raises(S.StoreError, match="isn't what was exported"):
        S.Store.restore(spark, f"{tmp_path}/snap", f"{tmp_path}/copy")


def test_a_long_group_takes_few_commits(spark, tmp_path, monkeypatch):
    """A commit for each turn of the longest group, once; what a block leaves is what its observations leave one by one."""
    rows = [r for r in some(3, groups=2, turns=14) if r[8] is not None or r[6] is None] + [row("h", i, "Ann", "city", v) for i, v in enumerate("xyxxzyx")]
    states, outcome = plainly(rows)
    for block, commits in ((64, 1), (5, 3)):
        monkeypatch.setattr(I, "BLOCK", block)
        store = S.Store(spark, f"{tmp_path}/store{block}")
        assert {r.observation_id: r.status for r in I.ingest(store, frame(spark, rows), "k").collect()} == outcome
        assert held(store) == states and len(store.load()) == commits
