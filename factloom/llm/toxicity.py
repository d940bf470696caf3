"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another: a model sees word and word-prefix rates and the probabilities of all
earlier categories. For training, those earlier probabilities are out-of-fold predictions, so a later model learns
from scores as noisy as the ones it gets in use. Each model is an L1-regularised logistic regression (proximal
Adagrad), trained on a bounded sample of labelled rows (``train_rows``, chosen by hash of doc_id); all documents are
scored, in one pass without a shuffle. The model that travels to the workers has at most 2**``bits`` weights.

Defined cases: null or empty text has no features and gets the models' base probability; rows with null labels don't
train; of several labels of one doc_id a category's one counts; with no labelled rows or one class only, the category's probability is its share of ones (0.0 without rows);
equal rows get equal scores, rows without a doc_id are scored and never train, several texts of a doc_id are rows each,
within ``train_rows``; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import keyed_text, without

#: Categories in chain order: name, label column, the label's value that counts as one.
CATEGORIES = (("junk", "quality", 0), ("toxic", "toxic", 1))
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 300_000


def word_features(word: str, bits: int) -> list[int]:
    mask = (1 << bits) - 1
    return [zlib.crc32(word.encode()) & mask, *(zlib.crc32(f"{word[:k]}*".encode()) & mask for k in PREFIXES if len(word) > k)]


def doc_features(text: str, bits: int, lookup):
    """(features, values): the rate of each feature per 100 words, at most 1."""
    words = WORD.findall(text.lower())
    counts: dict[int, int] = {}
    for w in words:
        for f in lookup(w):
            counts[f] = counts.get(f, 0) + 1
    ind = np.fromiter(counts.keys(), np.int32, len(counts))
    val = np.minimum(1.0, np.fromiter(counts.values(), np.float64, len(counts)) * 100 / (len(words) + 50))
    return ind, val


def fit(rows, ind, val, y, use, extra, dim, l1=5e-4, rounds=120):
    """(weights, weights of extra columns, bias) of a class-balanced logistic regression on the rows in ``use``."""
    n, share = use.sum(), y[use].mean() if use.any() else 0.0
    if share in (0.0, 1.0):
        return np.zeros(dim), np.zeros(extra.shape[1]), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    m = use[rows]
    r, i, v = rows[m], ind[m], val[m]
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * use / n
    w, u, b = np.zeros(dim), np.zeros(extra.shape[1]), 0.0
    gw, gu, gb = np.full(dim, 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(r, weights=w[i] * v, minlength=len(y)) + extra @ u + b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g, h = np.bincount(i, weights=e[r] * v, minlength=dim), extra.T @ e
        gw += g * g
        gu += h * h
        gb += e.sum() ** 2
        step = 0.5 / np.sqrt(gw)
        w -= step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        u -= 0.5 * h / np.sqrt(gu)
        b -= 0.5 * e.sum() / np.sqrt(gb)
    return w, u, float(b)


def predict(rows, ind, val, n, extra, model):
    w, u, b = model
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[ind] * val, minlength=n) + extra @ u + b, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, train_rows: int = 5000, bits: int = 18, folds: int = 3, least_df: int = 4):
    """[(name, {feature: weight}, weights of earlier categories, bias)] in chain order."""
    names = [f"y{i}" for i in range(len(categories))]
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) == one).cast("int").alias(y) for y, (_, c, one) in zip(names, categories, strict=True)]).dropna()
    chosen = chosen.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in names]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # a doc_id may have several texts: ids are taken in the same order while their rows fit, told by the ids alone
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *names).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most train_rows rows
    chosen = texts.withColumn("n", so_far).where(F.col("n") <= train_rows).drop("n")

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            out = [doc_features(x or "", bits, lambda w: word_features(w, bits)) for x in t["text"]]
            arrays = [pa.array(t["doc_id"], pa.int64()), pa.array([i.tobytes() for i, _ in out], pa.binary()), pa.array([v.tobytes() for _, v in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(t[y], pa.int32()) for y in names)], ["doc_id", "ind", "val", *names])

    got = keyed_text(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, ind binary, val binary, " + ", ".join(f"{y} int" for y in names)).toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["ind"]))
    n, dim = len(got), 1 << bits
    sizes = [len(r["ind"]) // 4 for r in got]
    rows = np.repeat(np.arange(n), sizes)
    ind = np.frombuffer(b"".join(r["ind"] for r in got), np.int32)
    val = np.frombuffer(b"".join(r["val"] for r in got), np.float64)
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % folds for r in got], dtype=int)
    truth = np.array([[float(r[y]) for y in names] for r in got]).reshape(n, len(names))
    del got
    common = np.bincount(ind, minlength=dim) >= least_df
    rows, ind, val = rows[common[ind]], ind[common[ind]], val[common[ind]]
    names_of, ind = np.unique(ind, return_inverse=True)
    extra, chain = np.zeros((n, 0)), []
    for k, (name, _, _) in enumerate(categories):
        y = truth[:, k]
        model = fit(rows, ind, val, y, np.ones(n, bool), extra, len(names_of))
        keep = np.flatnonzero(model[0])
        chain.append((name, dict(zip(names_of[keep].tolist(), model[0][keep].tolist(), strict=True)), model[1].tolist(), model[2]))
        if k + 1 < len(categories):
            held = np.zeros(n)
            for f in range(folds):
                held[fold == f] = predict(rows, ind, val, n, extra, fit(rows, ind, val, y, fold != f, extra, len(names_of)))[fold == f]
            extra = np.column_stack([extra, held])
    return chain


def score(docs: DataFrame, chain, bits: int = 18) -> DataFrame:
    """doc_id, p_<category> for each category of the chain."""
    useful = set().union(*(w for _, w, _, _ in chain)) if chain else set()

    def run(batches):
        cache: dict[str, tuple] = {}

        def lookup(word):
            got = cache.get(word)
            if got is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                got = cache[word] = tuple(f for f in word_features(word, bits) if f in useful)
            return got

        for batch in batches:
            ids = batch.column(0)
            out = []
            for text in batch.column(1):
                ind, val = doc_features(text.as_py() or "", bits, lookup)
                probs = []
                for _, w, u, b in chain:
                    z = b + sum(w.get(i, 0.0) * v for i, v in zip(ind.tolist(), val.tolist(), strict=True)) + sum(x * p for x, p in zip(u, probs, strict=True))
                    probs.append(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))
                out.append(probs)
            arrays = [pa.array([p[k] for p in out], pa.float64()) for k in range(len(chain))]
            yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *(f"p_{c[0]}" for c in chain)])

    return keyed_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c[0]} double" for c in chain))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.6, **options) -> DataFrame:
    """doc_id, p_junk, p_toxic, toxic."""
    out = score(docs, train(docs, labels, **options), options.get("bits", 18))
    return out.withColumn("toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The rows that the chain doesn't reject, all columns kept; rows without a doc_id are judged like others."""
    chain = train(docs, labels)
    return without(docs, lambda rows: score(rows, chain).where(F.col("p_toxic") >= threshold))
