"""Ranked lexical search with hashed max-sketches.

A document's impacts (its terms' saturated frequencies) fold into a sketch of ``width`` coordinates: each term is hashed
to one and the coordinate keeps the largest impact. Looking an item's terms up in the sketches of a block of documents
and adding weight * impact bounds the scores of all its items from above, in one matrix product. Documents are then
rescored exactly in descending order of bound until the bound falls below the tenth best score so far, which a task
carries from block to block. A task sends its ten best rows for each item; two ranked levels (by item and salt, then by
item) merge them.

Corpus counts (documents, terms, document frequencies of the items' terms) come from all documents in a pass before.
The items are a stated query set: they go to the workers in blocks of at most ``block_items`` items and about
``block_bytes`` of text, and each block is searched in all documents; where there are several, a block's ranks are
written and its broadcast is destroyed before the next. Documents are not shuffled. Terms are looked up by hash and
compared byte by byte, so no hash decides; equal hashes can only raise a bound.

Defined cases: null texts and texts without a term are no documents and no results; an item without a term has no
results; repeated items (also of one item_id) are ranked each for itself; repeated documents are separate documents,
each with its rank, and a null doc_id comes after all others of its score; empty tables give no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import _LOWER, Roller, chunks, cut, keyed_text

SEED = 67
#: Documents whose sketches are held at a time, and documents of an item rescored at a time.
BLOCK, STRIDE = 256, 16
SALTS = 256
INK = np.zeros(256, dtype=bool)
INK[0x30:0x3A] = INK[0x41:0x5B] = INK[0x61:0x7B] = INK[0x80:] = True


def terms_of(data: np.ndarray, offs: np.ndarray):
    """(lower-cased bytes, starts, ends, first term of each text plus the total)."""
    ink = np.zeros(len(data) + 1, dtype=bool)
    ink[:-1] = INK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge))
    ends = np.flatnonzero(before & (~ink | edge))
    return _LOWER[data], starts, ends, np.searchsorted(starts, offs)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every position, as one number (zeros after the end)."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


class Terms:
    """The distinct terms of a block of items, found in texts by hash and then byte by byte."""

    def __init__(self, words: list[bytes]):
        self.roll = Roller(SEED)
        self.data = np.frombuffer(b"".join(words), dtype=np.uint8)
        cuts = np.cumsum([0, *map(len, words)])
        h = self.roll.slices(self.roll.prefix(self.data), cuts[:-1], cuts[1:])
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        if len(words) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the items have one hash: choose another SEED")
        self.starts, self.sizes = cuts[:-1], np.diff(cuts)
        self.words = loads(self.data)

    def coordinates(self, width: int) -> np.ndarray:
        out = np.zeros(len(self.order), dtype=np.int64)
        out[self.order] = (self.hashes >> np.uint64(20)) % np.uint64(width)
        return out

    def find(self, data, starts, ends, h):
        """(which of the slices are terms, their term numbers)."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[hit]]
        size = self.sizes[term]
        same = ends[hit] - starts[hit] == size
        hit, term, size = hit[same], term[same], size[same]
        text, equal = loads(data), np.ones(len(hit), dtype=bool)
        k, todo = 0, np.arange(len(hit))
        while len(todo):
            n = np.minimum(size[todo] - k, 8).astype(np.uint64) * np.uint64(8)
            keep = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))
            equal[todo] &= ((text[starts[hit[todo]] + k] ^ self.words[self.starts[term[todo]] + k]) & keep) == 0
            k += 8
            todo = todo[size[todo] > k]
        return hit[equal], term[equal]


class Block:
    """A block of items: terms, and for each item its terms with how often it names them."""

    def __init__(self, items):
        self.ids = [i for i, _ in items]
        self.names: dict[bytes, int] = {}
        rows = []
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            low, s, e, _ = terms_of(raw, np.array([0, len(raw)]))
            whole = low.tobytes()
            for word, n in Counter(whole[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)).items():
                rows.append((k, self.names.setdefault(word, len(self.names)), n))
        self.item, self.term, self.times = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [])))
        self.words = list(self.names)


def counts(docs: DataFrame, sent) -> DataFrame:
    """(term, n): how many documents hold a term of the block; -1: documents with a term, -2: terms of all documents."""

    def run(batches):
        terms = Terms(sent.value.words)
        df, n_docs, n_terms = np.zeros(len(sent.value.words), dtype=np.int64), 0, 0
        for _, data, offs in chunks(batches):
            data, s, e, at = terms_of(data, offs)
            n_docs += int((np.diff(at) > 0).sum())
            n_terms += len(s)
            hit, term = terms.find(data, s, e, terms.roll.slices(terms.roll.prefix(data), s, e))
            doc = np.searchsorted(at, hit, "right") - 1
            df += np.bincount(np.unique(doc * len(df) + term) % max(1, len(df)), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[some].tolist()], pa.int64())], ["term", "n"])

    return keyed_text(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Best:
    """The ``k`` best rows of each item: highest score, then smallest doc_id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.null, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.tenth = np.ones(items, dtype=np.int64)  # a score above 0 is what enters while there is room

    def add(self, item, score, null, doc):
        good = score >= self.tenth[item]
        cols = [np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.null, null), (self.doc, doc))]
        order = np.lexsort((cols[3], cols[2], -cols[1], cols[0]))
        item = cols[0][order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        full = order[rank == self.k - 1]
        self.tenth[cols[0][full]] = cols[1][full]
        self.item, self.score, self.null, self.doc = (c[order[rank < self.k]] for c in cols)


class Searcher:
    """Bounds and exact scores of one block of items."""

    def __init__(self, block: Block, weight: np.ndarray, n_docs: int, n_terms: int, width: int, k: int):
        self.block, self.n_docs, self.n_terms = block, n_docs, n_terms
        self.terms, self.width = Terms(block.words), width
        self.gain = weight[block.term] * block.times
        coords = self.terms.coordinates(width)[block.term]
        self.used, column = np.unique(coords, return_inverse=True)
        self.lookup = np.zeros((len(self.used), len(block.ids)))
        np.add.at(self.lookup, (column, block.item), self.gain)
        self.first = np.searchsorted(block.item, np.arange(len(block.ids) + 1))
        self.best, self.rescored, self.pairs = Best(len(block.ids), k), 0, 0

    def impact(self, tf, n):
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def read(self, ids, data, offs):
        data, s, e, at = terms_of(data, offs)
        n = np.diff(at)
        h = self.terms.roll.slices(self.terms.roll.prefix(data), s, e)
        hit, term = self.terms.find(data, s, e, h)
        size = max(1, len(self.block.words))
        key, tf = np.unique((np.searchsorted(at, hit, "right") - 1) * size + term, return_counts=True)
        value = self.impact(tf, n[key // size])
        null = np.array([i is None for i in ids], dtype=np.int64)
        doc = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        for a in range(0, len(ids), BLOCK):
            b = min(a + BLOCK, len(ids))
            own = slice(at[a], at[b])
            part = slice(*np.searchsorted(key, (a * size, b * size)))
            if part.start < part.stop:
                self.rank(self.bounds(h[own], np.repeat(np.arange(b - a), n[a:b]), n[a:b]), key[part] - a * size, value[part], null[a:b], doc[a:b])

    def bounds(self, h, owner, n):
        """Upper bounds of the scores, documents by items."""
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        tf = np.diff(np.r_[first, len(h)])
        sketch = np.zeros((len(n), self.width))
        np.maximum.at(sketch, (owner[first], ((h[first] >> np.uint64(20)) % np.uint64(self.width)).astype(np.int64)), self.impact(tf, n[owner[first]]))
        return sketch[:, self.used] @ self.lookup

    def rank(self, bounds, key, value, null, doc):
        """Rescores the documents of each item by descending bound until the bound is below its tenth best score."""
        self.pairs += bounds.size
        items = np.flatnonzero((bounds >= self.best.tenth).any(axis=0))
        order = np.argsort(-bounds[:, items], axis=0, kind="stable")
        bounds = np.take_along_axis(bounds[:, items], order, 0)
        size = max(1, len(self.block.words))
        for at in range(0, len(bounds), STRIDE):
            d = order[at : at + STRIDE]
            row, column = np.nonzero(bounds[at : at + STRIDE] >= self.best.tenth[items])
            if not len(row):
                break
            who, item = d[row, column], items[column]
            n = self.first[item + 1] - self.first[item]
            start = np.cumsum(n) - n
            each = np.arange(n.sum()) - np.repeat(start - self.first[item], n)
            want = np.repeat(who, n) * size + self.block.term[each]
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            score = np.add.reduceat(np.where(key[place] == want, value[place] * self.gain[each], 0), start)
            self.rescored += len(score)
            self.best.add(item, score, null[who], doc[who])


RANKED = "number long, item_id long, score long, doc_id long"


def searched(docs: DataFrame, sent, k: int, width: int) -> DataFrame:
    """The k best rows of each item in each task."""

    def run(batches):
        block, weight, n_docs, n_terms = sent.value
        own = Searcher(block, weight, n_docs, n_terms, width, k)
        for ids, data, offs in chunks(batches):
            own.read(ids, data, offs)
        b = own.best
        if len(b.item):
            names = [block.ids[i] for i in b.item.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(b.item), pa.array(names, pa.int64()), pa.array(b.score), pa.array(b.doc, mask=b.null > 0)], [x.split()[0] for x in RANKED.split(", ")])

    return keyed_text(docs).mapInArrow(run, RANKED)


def blocks_of(items: DataFrame, block_items: int, block_bytes: int):
    """Lists of (item_id, text), read a partition at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if len(held) >= block_items or size >= block_bytes:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def search(docs: DataFrame, items: DataFrame, k: int = 10, width: int = 2048, block_items: int = 2000, block_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest score above 0."""
    spark = docs.sparkSession
    out = []
    blocks = blocks_of(items, block_items, block_bytes)
    block, following = next(blocks, None), None
    while block is not None:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast(block)
        found = {r["term"]: r["n"] for r in counts(docs, sent).collect()}  # at most the block's terms and two
        sent.destroy()
        n_docs, n_terms = found.get(-1, 0), found.get(-2, 0)
        if n_docs and block.words:
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(block.words))], dtype=np.int64)
            sent = spark.sparkContext.broadcast((block, weight, n_docs, n_terms))
            ranked = best(searched(docs, sent, k, width), k)
            if out or following is not None:
                ranked = cut(ranked)
                sent.destroy()
            out.append(ranked)
        block = following
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    """Ranks within (item, salt of the task), then within the item, so that no task reads all rows of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in (["number", "salt"], ["number"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")
