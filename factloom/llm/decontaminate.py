"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct word shingles into bands [2^g, 2^(g+1)). For a band, each document
is read as windows of two blocks of 2^(g+1) shingles, half overlapping, so a passage of an item lies in one window and
the containment threshold becomes a Jaccard threshold that doesn't depend on the document's length (0.8 of an item
gives at least 0.19). A window whose MinHash equals the item's in any of ``hashes`` functions is a candidate (missed
with probability 0.81**hashes at worst), verified by the exact share of the item's shingles in the whole document.

The items are a stated query set: they go to the workers in blocks of about ``block_items`` rows and ``block_bytes`` of
text at most, one pass over the documents for each block; where there are several, a block's matches are written and
its broadcast is destroyed before the next, so what is sent at once is bounded. Documents are not shuffled. Defined cases: words are
lower-cased (A-Z); items with fewer words than a shingle are one shingle, their whole word sequence, searched exactly in
the same pass; null or empty texts match nothing; repeated
documents and those without a doc_id give a row each; items with equal texts are separate; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Roller, chunks, cut, keyed_text, mix, without, words_of

SEED = 23


def shingles(batches, sizes, id_col: str = "doc_id"):
    """(ids, {size: (first shingle of each text plus total, shingle hashes in text order)})."""
    roll = Roller(SEED)
    steps = {k: np.random.default_rng(SEED).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in sizes}
    for ids, data, offs in chunks(batches, id_col):
        data, s, e, at = words_of(data, offs, lower=True)
        w = roll.slices(roll.prefix(data), s, e)
        out = {}
        for size, step in steps.items():
            total = max(0, len(w) - size + 1)
            acc = np.zeros(total, dtype=np.uint64)
            for i in range(size):
                acc += w[i : total + i] * step[i] if i == 0 else mix(w[i : total + i] * step[i])
            acc = mix(acc)
            n = np.maximum(0, np.diff(at) - size + 1)
            cuts = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum(n, out=cuts[1:])
            where = np.arange(cuts[-1]) - np.repeat(cuts[:-1], n) + np.repeat(at[:-1], n)
            out[size] = (cuts, acc[where])
        yield ids, out


class Index:
    """The items of one block: per size band the MinHash values, and the shingle sets for verification."""

    def __init__(self, items, hashes: int):
        self.sets = items
        self.mult = np.random.default_rng(SEED + 1).integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        bands: dict[int, list] = {}
        for k, (_, s) in enumerate(items):
            bands.setdefault(len(s).bit_length() - 1, []).append(k)
        self.bands = {}
        for g, members in bands.items():
            values = np.array([[(self.sets[k][1] * m).min() for k in members] for m in self.mult])
            order = np.argsort(values, axis=1, kind="stable")
            self.bands[g] = (np.take_along_axis(values, order, 1), np.array(members)[order])

    def candidates(self, cuts, h):
        """Pairs (document, item) that share a MinHash in some window."""
        found = set()
        n = np.diff(cuts)
        if not len(h):
            return found
        for g, (values, members) in self.bands.items():
            block = 2 << g
            blocks = -(-n // block)
            first = np.zeros(len(n) + 1, dtype=np.int64)
            np.cumsum(blocks, out=first[1:])
            doc = np.repeat(np.arange(len(n)), blocks)
            at = cuts[:-1][doc] + (np.arange(first[-1]) - first[doc]) * block
            near = np.append(doc[1:] == doc[:-1], False)
            for k, m in enumerate(self.mult):
                low = np.minimum.reduceat(h * m, at)
                low[:-1] = np.where(near[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                lo, hi = np.searchsorted(values[k], low, "left"), np.searchsorted(values[k], low, "right")
                for x in np.flatnonzero(hi > lo):
                    for i in range(lo[x], hi[x]):
                        found.add((int(doc[x]), int(members[k][i])))
        return found


def search(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, hashes: int = 40, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, n_item (its distinct shingles), n_shared, containment >= threshold."""
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    total = named.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-total["n"] // block_items), -(-(total["bytes"] or 0) // block_bytes))
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    out = []
    for b in range(blocks):
        rows = named if blocks == 1 else named.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b)
        sets, short = [], []
        for ids, grams in shingles(rows.toArrow().to_batches(), range(1, size + 1)):
            cuts, h = grams[size]
            words = np.diff(grams[1][0])
            sets += [(int(ids[i]), np.unique(h[cuts[i] : cuts[i + 1]])) for i in np.flatnonzero(words >= size)]
            short += [(int(ids[i]), int(words[i]), grams[words[i]][1][grams[words[i]][0][i]]) for i in np.flatnonzero((words > 0) & (words < size))]
        if sets or short:
            sent = spark.sparkContext.broadcast((sets, short))
            hits = keyed_text(docs).mapInArrow(_matcher(sent, size, threshold, hashes), schema)
            if blocks > 1:
                hits = cut(hits)
                sent.destroy()
            out.append(hits)
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], schema)


def short_items(rows):
    """{words: (sorted hashes, item ids)} of the items below a shingle's length."""
    out = {}
    for n in sorted({n for _, n, _ in rows}):
        mine = sorted((h, item) for item, m, h in rows if m == n)
        out[n] = (np.array([h for h, _ in mine], dtype=np.uint64), [item for _, item in mine])
    return out


def holders(cuts, h, names, items):
    """Pairs (document, item), once each, of documents that hold an item's whole word sequence."""
    lo = np.searchsorted(names, h, "left")
    hit = np.flatnonzero(names[np.minimum(lo, len(names) - 1)] == h)
    doc = np.searchsorted(cuts, hit, "right") - 1
    for d, k in sorted(set(zip(doc.tolist(), lo[hit].tolist(), strict=True))):
        for i in range(k, int(np.searchsorted(names, names[k], "right"))):
            yield d, items[i]


def _matcher(sets, size, threshold, hashes):
    def run(batches):
        index = Index(sets.value[0], hashes)
        short = short_items(sets.value[1])
        for ids, grams in shingles(batches, (size, *short)):
            cuts, h = grams[size]
            rows = [(None if ids[d] is None else int(ids[d]), item, 1, 1, 1.0) for n, (names, items) in short.items() for d, item in holders(*grams[n], names, items)]
            own: dict[int, np.ndarray] = {}
            for d, k in sorted(index.candidates(cuts, h)):
                if d not in own:
                    own = {d: np.unique(h[cuts[d] : cuts[d + 1]])}
                item, want = index.sets[k]
                at = np.searchsorted(own[d], want)
                shared = int((own[d][np.minimum(at, len(own[d]) - 1)] == want).sum())
                if shared >= threshold * len(want):
                    rows.append((None if ids[d] is None else int(ids[d]), item, len(want), shared, shared / len(want)))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, all columns kept; rows without a doc_id are searched like others."""
    return without(docs, lambda rows: search(rows, items))
