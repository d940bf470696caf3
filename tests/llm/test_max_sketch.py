"""Ranked search against plain scores, and what the bounds must hold."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import max_sketch as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            tf, m, score = Counter(w), 25 + (75 * len(w) * n_docs) // total, 0
            for t in terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some(r):
    words = ["a", "B", "cé", "Éa", "日本", "x1", "averyveryverylongwordindeed", "averyveryverylongwordindeez", *(f"w{i}" for i in range(60))]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "-", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(k, text(r.choice([1, 5, 30, 200]))) for k in range(700)]
    docs += [(k + 300, docs[k][1]) for k in range(40)] + [(None, docs[3][1]), (None, docs[9][1]), (None, None), (5, ""), (6, "..."), docs[0]]
    docs += [(2000, "big words " * 120_000), (2001, "w1 w2 " * 200_000)]
    items = [(k, text(r.choice([1, 3, 12]))) for k in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (3, "w1 W1 w2"), (None, "w5"), (33, "averyveryverylongwordindeed")]
    return docs, items


@pytest.mark.parametrize("width,block_items", [(2048, 2000), (4, 2000), (64, 7)])
def test_ranks(spark, width, block_items):
    docs, items = some(random.Random(3))
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], SCHEMA + ", score long, rank string").repartition(5)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = op.search(d, b, width=width, block_items=block_items)
    assert sorted(map(tuple, got.collect()), key=str) == plainly(docs, items)


def test_many_texts_without_an_item_term(spark):
    """Empty tables, and items that no document answers."""
    d = spark.createDataFrame([(1, "a b")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.search(d, none).collect() == []
    assert op.search(d, spark.createDataFrame([(1, "zz")], "item_id long, text string")).collect() == []
    assert op.search(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_bounds_hold_and_spare_rescoring():
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(300)], [f"r{i}" for i in range(3000)]
    docs = [" ".join([*r.choices(common, k=80), *r.choices(rare, k=40)]) for _ in range(2000)]
    block = op.Block([(k, " ".join(r.choices(docs[k * 7].split(), k=20))) for k in range(40)])
    raw = [t.encode() for t in docs]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    own = op.Searcher(block, np.full(len(block.words), 2000), len(docs), len(docs) * 120, 2048, 10)
    own.read(np.arange(len(docs)), data, offs)
    assert len(own.best.item) == 400
    assert own.rescored < 0.25 * own.pairs
