"""Stated dependencies against a plain search of every value in every side."""

import random
import re

from factloom.operators import intents

STATE = "group_id string, state_id int, entity string, attribute string, value string"
OBS = "group_id string, observation_id int, text string"


def plain(obs, states):
    words = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    out = set()
    for g, o, text in obs:
        for i, s in enumerate(re.findall(r"[^.!?]+(?:[.!?]+|$)", text or "")):
            m = re.match(r"^\s*(.+?)\s+depends\s+on\s+(.+?)\s*[.!?]*$", s, re.I)
            if not m:
                continue
            hits = [[x for x in states if x[0] == g and words(x[4]) and words(x[4]) in words(m.group(k))] for k in (1, 2)]
            if all(len(h) == 1 for h in hits):
                slots = [tuple(" ".join(y.lower().split()) for y in h[0][2:4]) + (words(h[0][4]),) for h in hits]
                if slots[0] != slots[1]:
                    out.add((g, o, i, hits[0][0][1], hits[1][0][1], s.strip()))
    return out


def test_stated(spark):
    r = random.Random(3)
    values = ["big tent", "tent", "rain-proof", "42", "Bus 7", "é toile", "", "...", "party", "art", None, "picnic"]
    states = [(r.choice("gh"), i, r.choice(["Ann", "ann", "Bob"]), "plan", r.choice(values)) for i in range(22)]
    bits = ["the Big Tent", "a tent", "Rain proof coat", "bus 7", "No 42", "É  toile", "party", "art", "picnic", "nothing"]
    text = lambda: "".join(f"{r.choice(bits)} {r.choice(['depends on', 'DEPENDS  on', 'depends', 'needs'])} {r.choice(bits)}{r.choice(['.', '! ', '?', ' depends on tent. ', chr(10)])}" for _ in range(r.randint(0, 5)))
    obs = [(r.choice("ghk"), i, r.choice([text(), text(), text(), None])) for i in range(300)]
    got = intents.stated(spark.createDataFrame([*obs, obs[0]], OBS), spark.createDataFrame([*states, states[0]], STATE)).collect()
    want = plain(obs, states)
    assert len(want) > 10
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_empty(spark):
    assert intents.stated(spark.createDataFrame([("g", 1, "a depends on b")], OBS), spark.createDataFrame([], STATE)).count() == 0


def test_pieces_are_looked_up_once_and_only_likely_ones(spark, monkeypatch):
    """Every piece of every side was once dealt by its text, for each side anew."""
    values = ["Customer#0001", "Customer#0002", "x", "Über#7", "abc"]
    states = spark.createDataFrame([("g", i, f"e{i}", "a", v) for i, v in enumerate(values)], "group_id string, state_id long, entity string, attribute string, value string")
    said = [f"The order of {a} depends on that of {b}. So it is!" for a in values for b in values]
    obs = spark.createDataFrame([("g", i, t) for i, t in enumerate(said)], "group_id string, observation_id long, text string")
    got = intents.stated(obs, states)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "filter(sequence" in plan
    rows = {tuple(r) for r in got.collect()}
    assert rows
    monkeypatch.setattr(intents, "HEADS", 0)  # no piece is left out
    assert {tuple(r) for r in intents.stated(obs, states).collect()} == rows
