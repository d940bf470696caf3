"""Answer contexts against a plain walk over each question's items."""

import random

import pytest

from factloom.operators import answers


def plain(texts, most, room):
    out, left, cut = [], room, len(texts) > most
    for t in texts[:most]:
        t = t or ""
        if not t:
            continue
        cut |= len(t) > left
        if left == 0:
            break
        out.append(t[:left])
        left -= len(out[-1])
    return out, cut


@pytest.mark.parametrize("room", [0, 12, 30, 500])
def test_contexts(spark, room):
    r = random.Random(room)
    items = {q: [r.choice([None, "", "é" * r.randint(1, 12), "x😀" * r.randint(1, 6)]) for _ in range(r.randint(1, 14))] for q in range(60)}
    df = spark.createDataFrame([(q, 100 - i, t, "extra") for q, ts in items.items() for i, t in reversed(list(enumerate(reversed(ts))))], "question_id int, place int, text string, n string")
    got = {x.question_id: x for x in answers.contexts(df, 10, room).collect()}
    assert set(got) == set(items)
    for q, ts in items.items():
        used, cut = plain(ts, 10, room)
        x = got[q]
        assert x.context == "\n\n".join(f"[{i}] {t}" for i, t in enumerate(used, 1))
        assert (x.source_items, x.used_items, x.used_characters, x.truncated) == (len(ts), len(used), sum(map(len, used)), cut)
        assert x.estimated_tokens == (sum(map(len, used)) + 3) // 4


def test_empty(spark):
    assert answers.contexts(spark.createDataFrame([], "question_id int, place int, text string")).count() == 0
