"""Brute force for what SQL can't say: marginals by enumeration, recall of the containment search, the chain and its folds."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from factloom.llm import decontaminate, html_tree, toxicity


def random_page(r):
    tags = ["div", "p", "section", "nav", "article", "ul", "li", "aside"]
    out, n = [], 0

    def grow(depth):
        nonlocal n
        while n < 8 and r.random() < (0.8 if depth < 3 else 0.3):
            n += 1
            t = r.choice(tags)
            out.append(f"<{t} class='{r.choice(['menu', 'body', 'ad', 'main'])}'>{' '.join(['word'] * r.randrange(12))}")
            grow(depth + 1)
            out.append(f"</{t}>")

    grow(0)
    return "".join(out)


def test_marginals_are_those_of_all_assignments():
    model = html_tree.train(html_tree.labelled_pages(60), rounds=60)
    r = random.Random(1)
    seen = 0
    for _ in range(40):
        page = html_tree.Page(random_page(r))
        n = len(page.parent)
        if not 2 <= n <= 9:
            continue
        seen += 1
        phi = [(1.0, 1e-6, 1e-2), *(model.node(page.features(i)) for i in range(1, n))]
        total = np.zeros((n, 3))
        for states in itertools.product(range(3), repeat=n):
            weight = math.prod(phi[i][s] for i, s in enumerate(states)) * math.prod(model.exp_edges[states[page.parent[i]]][states[i]] for i in range(1, n))
            for i, s in enumerate(states):
                total[i, s] += weight
        assert np.allclose(model.marginals(page), total / total.sum(1, keepdims=True), atol=1e-9)
    assert seen > 15


def test_recall_of_the_containment_search(spark):
    """Items of 15 to 60 words in long documents, whole and with words changed, against exact containment of all pairs."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    items = [[r.choice(words) for _ in range(r.randrange(15, 60))] for _ in range(120)]
    docs = []
    for k in range(360):
        text = [r.choice(words) for _ in range(r.choice([20, 400, 3000]))]
        piece = list(items[k % 120])
        for _ in range(k % 4):  # each change takes up to five shingles
            piece[r.randrange(len(piece))] = "changed"
        at = r.randrange(len(text))
        docs.append(text[:at] + piece + text[at:])
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [grams(x) for x in items]
    want = {}
    for d, text in enumerate(docs):
        own = grams(text)
        for i, s in enumerate(sets):
            shared = len(own & s)
            if shared >= 0.8 * len(s):
                want[d, i] = (len(s), shared, shared / len(s))
    frame = lambda rows, names: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], names)
    found = decontaminate.search(frame(docs, "doc_id long, text string").repartition(4), frame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): (x.n_item, x.n_shared, x.containment) for x in found}
    assert len(want) > 150 and min(x[2] for x in want.values()) < 0.9
    assert all(want[p] == x for p, x in got.items())  # nothing that isn't there
    assert len(got) >= 0.99 * len(want)
    # the same in several blocks of items
    blocks = decontaminate.search(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), block_items=50).collect()
    assert {(x.doc_id, x.item_id) for x in blocks} == set(got)


def labelled(n, seed=0):
    """Junk texts hold symbols words; toxic ones insult, mostly in junk."""
    r = random.Random(seed)
    plain = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows = []
    for i in range(n):
        junk = r.random() < 0.4
        toxic = r.random() < (0.6 if junk else 0.05)
        text = [r.choice(plain) for _ in range(60)] + ["buynow", "clickhere"] * (3 if junk else 0) + ["vile", "scum"] * (2 if toxic else 0)
        r.shuffle(text)
        rows.append((i, " ".join(text), int(not junk), int(toxic)))
    return rows


def test_chain_is_scored_as_it_is_written(spark):
    rows = labelled(240)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int"))
    assert [c[0] for c in chain] == ["junk", "toxic"] and len(chain[0][2]) == 0 and len(chain[1][2]) == 1 and chain[1][2][0] > 0
    got = {r.doc_id: (r.p_junk, r.p_toxic) for r in toxicity.score(docs, chain).collect()}
    for i, text, quality, toxic in rows:
        words = text.split()
        names = [w for w in words] + [f"{w[:k]}*" for w in words for k in toxicity.PREFIXES if len(w) > k]
        rate = {}
        for name in names:
            f = zlib.crc32(name.encode()) & ((1 << 18) - 1)
            rate[f] = rate.get(f, 0) + 1
        p = []
        for _, w, u, b in chain:
            z = b + sum(w.get(f, 0.0) * min(1.0, c * 100 / (len(words) + 50)) for f, c in rate.items()) + sum(x * y for x, y in zip(u, p))
            p.append(1 / (1 + math.exp(-z)))
        assert got[i] == pytest.approx(tuple(p))
    held = labelled(200, seed=9)
    out = toxicity.score(spark.createDataFrame([x[:2] for x in held], "doc_id long, text string"), chain).collect()
    assert sum((r.p_toxic >= 0.5) == bool(held[r.doc_id][3]) for r in out) > 190


def test_conflicting_labels_have_a_rule(spark):
    rows = labelled(120)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = [(i, q, t) for i, _, q, t in rows]
    twice = labels + [(i, 1, 0) for i, _, _ in labels]
    a = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    b = toxicity.train(docs.repartition(5), spark.createDataFrame(twice, "doc_id long, quality int, toxic int").repartition(7))
    assert a == b
    few = toxicity.train(docs.union(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), train_rows=40)
    assert [c[0] for c in few] == ["junk", "toxic"]
