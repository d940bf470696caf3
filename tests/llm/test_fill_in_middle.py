"""Fill-in-the-middle against a plain regular expression, and back."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import fill_in_middle as op

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKS = ("<P>", "<S>", "<M>")


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def some_texts():
    r = random.Random(1)
    letters = ["a", "b", " ", "\n", "\t", "é", "ß", "日", "😀", " ", "\x0b", "\x1f", "\x0e", "\x08", "\x00", " ", "<", "S", ">"]
    rows = [(k, "".join(r.choice(letters) for _ in range(r.randrange(60)))) for k in range(1500)]
    odd = [(None, "a b c"), (None, None), (7, None), (7, ""), (8, "x <P> y"), (9, "  "), (9, "word"), (9, "word"), (11, "x"), (12, "<S>"), (13, "a<M>")]
    return rows + odd + [(10_000 + k, "ab cé " * 200_000) for k in range(4)]  # over the chunk of 1 MB


def test_forms_and_round_trip(spark):
    rows = some_texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, output string").repartition(3)
    got = op.transform(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([plainly(*x) for x in rows], key=str)
    back = got.select(op.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(b.t for b in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got.select("form").collect()} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert op.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 64])
def test_rank_and_select(size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    marks = op.Marks(op.white(op.as_words(data)))
    at = np.flatnonzero(np.isin(data, [9, 10, 11, 12, 13, 32]))
    assert marks.select(np.arange(len(at))).tolist() == at.tolist()
    assert marks.rank(np.arange(size + 1)).tolist() == [int((at < k).sum()) for k in range(size + 1)]
