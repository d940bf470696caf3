"""Quality by a generalised additive model with pairwise interactions.

Every text gets a short row of figures (lengths, kinds of characters, repeats); each figure is cut into at most
``bins`` bins at quantiles. The model is a table of log-odds for each figure and, for the pairs with the strongest
interactions, a table over both bins. Boosting goes round the figures cyclically: in its turn each one gets a shallow tree
(two levels of cuts) on the gradient of the log-loss, added to its table at a small rate; the pairs' tables follow in
the same way, by trees with one cut in either figure. A held-back part of the training rows chooses how many rounds
are kept. A document's score is the sum of table entries, added bin by bin for a whole batch, without a shuffle.

Training rows are labelled rows of the given condition, at most ``train_rows`` of them by hash, so what comes to the
driver is bounded: ``train_rows`` rows of figures. Only the text is an input of the score.

Defined cases: null or empty text has all figures zero and is scored as such; documents without a label, with a null
label or a null doc_id don't train but are scored; of several labels of one doc_id the lowest quality counts; several
rows of a doc_id are training rows each, within the bound; without training rows every score is 0.5, with one class
only it is that class's share; equal texts get equal scores; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Roller, chunks, keyed_text, mix, words_of

SEED = 83
KINDS = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "symbol": b"#*$%&|<>", "call": b"!?", "stop": b".,;:", "line": b"\n", "other": range(0x80, 0x100)}
FIGURES = ("words", "word_length", "upper", "digit", "symbol", "call", "stop", "line", "other", "same_as_before", "distinct", "window_repeats", "line_repeats", "longest", "bare", "per_sentence", "short", "commonest")


def figures(data: np.ndarray, offs: np.ndarray, roll: Roller) -> np.ndarray:
    """A row of FIGURES for each text of a chunk."""
    docs = len(offs) - 1
    _, s, e, at = words_of(data, offs)
    n = np.diff(at)
    doc = np.repeat(np.arange(docs), n)
    some, size = np.maximum(n, 1), np.maximum(np.diff(offs), 1)

    def total(mask):
        c = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=c[1:])
        return c

    sums = {}
    for kind, members in KINDS.items():
        is_one = np.zeros(256, dtype=bool)
        is_one[list(members)] = True
        sums[kind] = total(is_one[data])
    high = np.zeros(len(data), dtype=bool)  # capital letters of Latin-1 take two bytes, 0xC3 first
    high[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    count = {kind: c[offs[1:]] - c[offs[:-1]] for kind, c in sums.items()}
    high = np.diff(total(high)[offs])
    letter = sum(sums[k] for k in ("upper", "lower", "digit", "other"))

    h = roll.slices(roll.prefix(data), s, e)
    own = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    names, first, back, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    most = np.zeros(docs, dtype=np.int64)
    np.maximum.at(most, doc[first], times)
    window = mix(own[:-2] + mix(own[1:-1] + mix(own[2:]))) if len(own) > 2 else own[:0]
    inside = doc[: len(window)] == doc[2:] if len(own) > 2 else np.zeros(0, dtype=bool)
    wdoc = doc[: len(window)][inside]
    _, wfirst = np.unique(window[inside], return_index=True)
    windows, fresh = np.bincount(wdoc, minlength=docs), np.bincount(wdoc[wfirst], minlength=docs)

    edge = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data))
    ldoc = np.searchsorted(offs, edge, "right") - 1
    width = np.where(data[stop - 1] == 10, stop - 1, stop) if len(edge) else stop
    line = mix(roll.slices(roll.prefix(data), edge, width) + ldoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    filled = width > edge
    _, lfirst = np.unique(line[filled], return_index=True)
    lines, fresh_lines = np.bincount(ldoc[filled], minlength=docs), np.bincount(ldoc[filled][lfirst], minlength=docs)

    length = e - s
    longest = np.zeros(docs, dtype=np.int64)
    np.maximum.at(longest, doc, length)
    letters = count["upper"] + count["lower"] + count["other"] / 2
    cols = [
        np.log1p(n),
        np.bincount(doc, weights=length, minlength=docs) / some,
        (count["upper"] + high) / np.maximum(letters, 1),
        count["digit"] / size,
        count["symbol"] / some,
        count["call"] / some,
        count["stop"] / some,
        count["line"] / some,
        count["other"] / size,
        np.bincount(doc[again], minlength=docs) / some,
        np.bincount(doc[first], minlength=docs) / some,
        (windows - fresh) / np.maximum(windows, 1),
        (lines - fresh_lines) / np.maximum(lines, 1),
        np.log1p(longest),
        np.bincount(doc[letter[e] == letter[s]], minlength=docs) / some,
        n / (1 + count["stop"]),
        np.bincount(doc[length <= 2], minlength=docs) / some,
        most / some,
    ]
    return np.column_stack([np.asarray(c, dtype=np.float64) for c in cols]).reshape(docs, len(FIGURES))


def gains(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> np.ndarray:
    return g * g / (h + least)


def shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of two levels on the bins of a figure, from each bin's gradient and weight."""
    out = np.zeros(len(g))

    def grow(a, b, level):
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if level and b - a > 1:
            gain = gains(cg[:-1], ch[:-1]) + gains(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            k = int(np.argmax(gain))
            if gain[k] > gains(cg[-1], ch[-1]) + 1e-9:
                grow(a, a + k + 1, level - 1)
                grow(a + k + 1, b, level - 1)
                return
        out[a:b] = cg[-1] / (ch[-1] + 1.0)

    grow(0, len(g), 2)
    return out


def crossed(g: np.ndarray, h: np.ndarray):
    """(gain, values) of the best tree with one cut in either figure of a pair, from grids of gradients and weights."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c):
        a, r, d, t = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, r - a, d - a, t - r - d + a

    parts = list(zip(corners(cg), corners(ch), strict=True))
    gain = sum(gains(x, y) for x, y in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [float(x[i, j] / (y[i, j] + 1.0)) for x, y in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - gains(cg[-1, -1], ch[-1, -1])), out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Bias, cuts and tables; ``score`` adds table entries."""

    def __init__(self, bias: float, edges, tables, pairs):
        self.bias, self.edges, self.tables, self.pairs = bias, edges, tables, pairs

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(cut, x[:, f], "right") for f, cut in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.binned(x), np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 60) -> Model:
    """Boosts tables on the rows that are not ``held`` and keeps the rounds that are best on those that are."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))), [], [], [])
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(c) + 1) for c in edges], [])
    b, z = model.binned(x), np.full(len(y), model.bias)
    own = ~held if (~held).any() else np.ones(len(y), dtype=bool)
    judge = held if held.any() else own

    def loss():
        p = np.clip(sigmoid(z[judge]), 1e-9, 1 - 1e-9)
        return float(-(y[judge] * np.log(p) + (1 - y[judge]) * np.log(1 - p)).mean())

    def slopes():
        p = sigmoid(z[own])
        return y[own] - p, p * (1 - p)

    def sums(cell, size):
        g, h = slopes()
        return np.bincount(cell, weights=g, minlength=size), np.bincount(cell, weights=h, minlength=size)

    def boost(tables, cells, tree, turns):
        """``turns`` rounds over all tables; the best state by the judge is what stays."""
        nonlocal z
        lowest, best, best_z = loss(), [t.copy() for t in tables], z.copy()
        since = 0
        for _ in range(turns):
            for k, t in enumerate(tables):
                g, h = sums(cells[k][own], t.size)
                step = rate * tree(g.reshape(t.shape), h.reshape(t.shape))
                t += step
                z += step.reshape(-1)[cells[k]]
            now = loss()
            since += 1
            if now < lowest - 1e-6:
                lowest, best, best_z, since = now, [t.copy() for t in tables], z.copy(), 0
            if since >= 20:
                break
        z = best_z
        return best

    model.tables = boost(model.tables, [b[:, f] for f in range(b.shape[1])], shallow, rounds)
    ranked = []
    for i in range(b.shape[1]):
        for j in range(i + 1, b.shape[1]):
            shape = (len(edges[i]) + 1, len(edges[j]) + 1)
            if min(shape) > 1:
                g, h = sums((b[:, i] * shape[1] + b[:, j])[own], shape[0] * shape[1])
                ranked.append((-crossed(g.reshape(shape), h.reshape(shape))[0], i, j, shape))
    chosen = [(i, j, shape) for _, i, j, shape in sorted(ranked)[:pairs]]
    tables = boost([np.zeros(s) for _, _, s in chosen], [b[:, i] * s[1] + b[:, j] for i, j, s in chosen], lambda g, h: crossed(g, h)[1], pair_rounds)
    model.pairs = [(i, j, t) for (i, j, _), t in zip(chosen, tables, strict=True)]
    return model


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; 0 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def measured(docs: DataFrame, kept: str = "doc_id long") -> DataFrame:
    """The first column and the figures, as little-endian doubles."""
    name = kept.split()[0]

    def run(batches):
        roll = Roller(SEED)
        for ids, data, offs in chunks(batches, name):
            x = figures(data, offs, roll)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], [name, "x"])

    return docs.mapInArrow(run, f"{kept}, x binary")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, held_out: int = 2, **options) -> Model:
    """Fits the model on labelled rows whose remainder is not ``held_out``."""
    doc_id = F.col("doc_id").cast("long")
    chosen = labels.select(doc_id.alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(remainder(F.col("doc_id")) != held_out)
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # the label travels with the id, as the lowest bit, so that the figures need one column beside them
    keyed = keyed_text(docs).join(F.broadcast(chosen), "doc_id").select((F.shiftleft("doc_id", 1) + (F.col("quality") > 0).cast("long")).alias("row"), "text")
    rows = measured(keyed, "row long").orderBy(F.xxhash64("row", "x"), "row", "x").limit(train_rows).toArrow().to_pylist()
    x = np.frombuffer(b"".join(r["x"] for r in rows)).reshape(-1, len(FIGURES))
    row = np.array([r["row"] for r in rows], dtype=np.int64)
    held = mix((row >> 1).astype(np.uint64)) % np.uint64(6) == 0
    return fit(x, (row & 1).astype(float), held, **options)


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the chance of quality 1."""

    def run(batches):
        roll = Roller(SEED)
        for ids, data, offs in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(figures(data, offs, roll)))], ["doc_id", "score"])

    return keyed_text(docs).mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on)."""
    out = score(docs, train(docs, labels, held_out=held_out, **options))
    return out.select("doc_id", (remainder(F.col("doc_id")) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
