"""The additive model: figures against plain Python, held-out accuracy, tables that add up, defined cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import additive as op
from factloom.llm import queries
from factloom.llm.common import Roller

SF = "/root/testdata/sf0.01"


def plain_figures(text):
    raw = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, some = len(w), max(1, len(w))
    count = lambda members: sum(raw.count(bytes([c])) for c in set(members))
    upper, lower, other = (count(op.KINDS[k]) for k in ("upper", "lower", "other"))
    high = sum(len(re.findall(bytes([0xC3, c]), raw, re.S)) for c in range(0x80, 0x9F))
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(n), sum(map(len, w)) / some, (upper + high) / max(1, upper + lower + other / 2), count(op.KINDS["digit"]) / max(1, len(raw)), count(b"#*$%&|<>") / some,
        count(b"!?") / some, count(b".,;:") / some, count(b"\n") / some, other / max(1, len(raw)), sum(a == b for a, b in zip(w, w[1:])) / some, len(set(w)) / some,
        (len(windows) - len(set(windows))) / max(1, len(windows)), (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(max(map(len, w), default=0)),
        sum(not re.search(rb"[A-Za-z0-9\x80-\xFF]", x) for x in w) / some, n / (1 + count(b".,;:")), sum(len(x) <= 2 for x in w) / some, max(Counter(w).values(), default=0) / some,
    ]


def test_figures():
    r = random.Random(2)
    words = ["a", "Bc", "é", "ÉÀ", "12", "*", "!!", "x.", "日本", "\n", "\n\n", "same same"]
    texts = ["", " ", "\n", "Ê", *("".join(r.choice(words) + r.choice([" ", "\n", ""]) for _ in range(r.randrange(50))) for _ in range(200)), ""]
    raw = [t.encode() for t in texts]
    got = op.figures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), Roller(op.SEED))
    assert np.allclose(got, [plain_figures(t) for t in texts])


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op13_additive_quality"](spark, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_never_train(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = op.train(docs, labels), op.train(docs.repartition(3), turned)
    assert a.bias == b.bias and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_interaction_is_found():
    """A label that is the exclusive or of two figures needs a pair's table."""
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 2] > 0.5)).astype(float)
    held = np.arange(4000) % 5 == 0
    model = op.fit(x, y, held, bins=16)
    assert (0, 2) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert ((op.fit(x, y, held, bins=16, pairs=0).score(x) > 0.5) == y).mean() < 0.7


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0), (1, 1), (3, None), (None, 1)], [(1, 1), (2, 0), (3, 1), (9, 0)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(1, "a b", 1, 2.0), (1, "a c", 1, 2.0), (2, None, 0, 1.0), (None, "a b", 3, 1.0), (3, "", 1, 1.0), (9, "x " * 700_000, 1, 1.0)], "doc_id long, text string, quality int, score double")
    got = op.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    if not labels:
        assert {r.score for r in got} == {0.5}
    if labels[:2] == [(1, 1), (2, 1)]:
        assert all(r.score > 0.999 for r in got)
    if labels[:2] == [(1, 0), (1, 1)]:
        assert all(r.score < 0.001 for r in got)
    assert op.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []
