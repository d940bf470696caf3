"""The registered queries against their SQL twins, components and spans of long texts."""

import os
import random

import duckdb
import numpy as np
import pytest

from factloom.llm import components, queries, recompression, secret_ledger, suffix_blocks
from factloom.llm.common import Roller

SF = "/root/testdata/sf0.001"


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df, twin = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(twin.fetchall(), twin.columns)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 560)}


def test_windows_of_texts_over_one_span(monkeypatch):
    """A window has the same least m-gram however the text is cut into spans."""
    data = np.random.default_rng(4).integers(97, 100, 5000).astype(np.uint8)
    offs, roll = np.array([0, 1200, 1250, 5000]), Roller(53)

    def grams():
        first, last, h = suffix_blocks.runs_of_windows(data, offs, roll, 100)
        return {w: int(x) for a, b, x in zip(first, last, h, strict=True) for w in range(a, b)}

    whole = grams()
    monkeypatch.setattr(suffix_blocks, "SPAN", 700)
    assert grams() == whole and len(whole) == 1101 + 3651


def test_many_secrets_in_a_text(spark):
    r = random.Random(1)
    text = " ".join(r.choice(["x", "password=abcdefgh12", "token: short"]) for _ in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found, _ = secret_ledger.scan(docs)
    got = sorted((f.start, f.end) for f in found.collect())
    at, want = 0, []
    while (at := text.find("password=", at)) >= 0:
        want.append((at, at + 19))
        at += 19
    assert got == want


@pytest.mark.parametrize("levels", [0, 2, 4])
def test_equal_windows_have_equal_forms(levels):
    """Runs, ties and document edges: a form is equal exactly where the words are, and its anchor with it."""
    r = random.Random(levels)
    texts = [" ".join(r.choice("ab" if i % 2 else "abcdef") for _ in range(r.choice([5, 13, 60, 400]))) for i in range(40)] + ["a " * 50, "", "a b " * 30]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    rolls = [Roller(41), Roller(42)]
    (anchor, rung, a, b), ladder, _, start, owner, inner = recompression.windows(np.arange(len(texts)), data, offs, rolls, 13, levels)
    forms = recompression.form(ladder, rung, a, b, start, 13, rolls[0])
    words = [tuple(texts[o].split()[i : i + 13]) for o, i in zip(owner, inner, strict=True)]
    pairs = set(zip(words, map(int, forms), map(int, anchor), strict=True))
    assert len(pairs) == len(set(words)) == len(set(map(int, forms)))
    assert not levels or (rung > 0).mean() > 0.5
