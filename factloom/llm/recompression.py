"""Substring dedup on words by recompression.

Each round first names maximal runs of one symbol and then pairs (left symbol of class L, right one of class R, by a
bit of the symbol). Names are hashes of what they stand for, so a round names the same run or pair alike everywhere
without any exchange. A symbol carries the words it spans and the words its form depends on; equal substrings have the
same symbols wherever that dependence lies inside them. So each window of ``window`` words has a form that its words
alone determine: the symbols of the highest level that depend on nothing outside it, where they begin, and the words
they leave at its edges. Equal windows have equal forms, and a form stands for one sequence of words: shared symbols
cover the inside of a repeat, only its edges are compared by words. The least of the symbols names the bucket, Spark
brings the windows that share it together, their forms (64 bits) decide, and a second hash of all words (32 bits,
independent of the symbols) verifies.

The symbols are handled in ``rounds`` slices, each a pass over the texts and one shuffle whose files go before the next
slice, which bounds the disk. A chunk of documents sends a window once, with its least doc_id; the others are settled
where they are, so a passage in a third of all rows costs a row for each chunk. Defined cases: null or empty text has
no words; texts under ``window`` words keep all; rows with one doc_id count as one document for "smaller doc_id", but
each text of it has its own windows (told apart by its crc32); rows without a doc_id come before and after no other, so
they keep all; equal rows get equal results; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import PACKED, Outbox, Roller, chunks, cut, dealt, keyed_text, mix, packed, partitions_of, release, words_of

WINDOW = np.dtype([("h", "<u8"), ("doc", "<i8"), ("check", "<u4"), ("name", "<u4"), ("at", "<u4")])
HIT = np.dtype([("doc", "<i8"), ("name", "<u4"), ("at", "<u4")])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def next_level(name, first, last, lo, hi, doc):
    """Symbols after naming runs and then pairs: names, word span [first, last), dependence [lo, hi), document."""
    n = len(name)
    if not n:
        return name, first, last, lo, hi, doc
    inside = doc[1:] == doc[:-1]
    head = np.r_[True, ~(inside & (name[1:] == name[:-1]))]
    at = np.flatnonzero(head)
    end = np.append(at[1:], n)
    count = (end - at).astype(np.uint64)
    # a run depends on its neighbours' being other symbols; beyond the document's edge nothing is inside a window
    left, right = at - 1, end
    left_in = (at > 0) & (doc[np.maximum(left, 0)] == doc[at])
    right_in = (right < n) & (doc[np.minimum(right, n - 1)] == doc[at])
    new_lo = np.where(left_in, lo[np.maximum(left, 0)], first[at] - 1)
    new_hi = np.where(right_in, hi[np.minimum(right, n - 1)], last[end - 1] + 1)
    name = np.where(count > 1, mix(name[at] * _A + count), name[at])
    first, last, doc, lo, hi = first[at], last[end - 1], doc[at], np.minimum(new_lo, lo[at]), np.maximum(new_hi, hi[end - 1])
    n = len(name)
    right_class = (mix(name ^ _B) & np.uint64(1)).astype(bool)
    inside = np.append(doc[1:] == doc[:-1], False)
    pair = inside & ~right_class & np.append(right_class[1:], False)
    second = np.append(False, pair[:-1])
    nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    before = np.append(False, inside[:-1])
    # a left symbol that stays single depends on the next one, a right symbol on the one before
    solo_hi = np.where(~right_class & ~pair, np.where(inside, hi[nxt], last + 1), hi)
    solo_lo = np.where(right_class & ~second, np.where(before, lo[prv], first - 1), lo)
    name = np.where(pair, mix(name * _A + mix(name[nxt] * _B)), name)
    keep = ~second
    return name[keep], first[keep], np.where(pair, last[nxt], last)[keep], np.where(pair, np.minimum(lo, lo[nxt]), np.minimum(solo_lo, lo))[keep], np.where(pair, np.maximum(hi, hi[nxt]), np.maximum(solo_hi, hi))[keep], doc[keep]


def inside(level, start, width):
    """For windows [start, start + width): the range [a, b) of the level's symbols whose dependence lies inside."""
    _, _, _, lo, hi, _ = level
    return np.searchsorted(lo, start, "left"), np.searchsorted(hi, start + width, "right")


def least(name, a, b):
    """Least name of each range [a, b); none is empty."""
    best, k = name[a], 1
    live = np.flatnonzero(b > a + 1)
    while len(live):
        best[live] = np.minimum(best[live], name[a[live] + k])
        k += 1
        live = live[a[live] + k < b[live]]
    return best


def windows(ids, data, offs, rolls, width: int, levels: int):
    """Of a chunk: per window its (anchor symbol, level, symbol range [a, b)), the ladder of levels, the words' second names, and first word, document index and start in it per window."""
    _, s, e, at = words_of(data, offs)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(ids)), n)
    words = [r.slices(r.prefix(data), s, e) for r in rolls]
    count = np.maximum(0, n - width + 1)
    owner = np.repeat(np.arange(len(ids)), count)
    first = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    inner = np.arange(first[-1]) - first[owner]
    start = at[owner] + inner
    here = np.arange(len(s))
    ladder = [(words[0], here, here + 1, here, here + 1, doc)]
    for _ in range(levels):
        ladder.append(next_level(*ladder[-1]))
    anchor, rung = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int8)
    a, b = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    left = np.arange(len(start))
    for k in range(levels, -1, -1):  # the words themselves always lie inside
        x, y = inside(ladder[k], start[left], width)
        some = y > x
        mine = left[some]
        a[mine], b[mine], rung[mine] = x[some], y[some], k
        anchor[mine] = least(ladder[k][0], a[mine], b[mine])
        left = left[~some]
        if not len(left):
            break
    return (anchor, rung, a, b), ladder, words[1], start, owner, inner


def sums(names: np.ndarray, roll: Roller) -> np.ndarray:
    roll.powers(len(names) + 1)
    c = np.zeros(len(names) + 1, dtype=np.uint64)
    np.cumsum(names * roll.pow[: len(names)], out=c[1:])
    return c


def span_hash(c: np.ndarray, a: np.ndarray, b: np.ndarray, roll: Roller) -> np.ndarray:
    """Polynomial hash of the names in [a, b), from their sums."""
    return mix((c[b] - c[a]) * roll.inv[a])


def form(ladder, rung, a, b, start, width: int, roll: Roller) -> np.ndarray:
    """Name of each window's form: level, shared symbols, where they begin, and the words at both edges that they leave."""
    out = np.empty(len(start), dtype=np.uint64)
    words = sums(ladder[0][0], roll)
    for k, (name, first, last, *_) in enumerate(ladder):
        at = np.flatnonzero(rung == k)
        if not len(at):
            continue
        begin, x, y = start[at], a[at], b[at]
        h = span_hash(sums(name, roll) if k else words, x, y, roll)
        if k:
            lead = first[x]
            h = mix(h * _A + span_hash(words, begin, lead, roll))
            h = mix(h * _B + span_hash(words, last[y - 1], begin + width, roll)) + (lead - begin).astype(np.uint64)
        out[at] = h + np.array([k], np.uint64) * _A
    return mix(out)


def slice_rows(docs: DataFrame, turn: int, rounds: int, width: int, levels: int) -> DataFrame:
    """Packed windows of one slice of symbols; buckets below 0 hold windows that are settled already."""
    buckets = partitions_of(docs.sparkSession) * 2

    def run(batches):
        rolls = [Roller(41), Roller(42)]
        box = Outbox(buckets)
        for ids, data, offs in chunks(batches):
            (anchor, rung, a, b), ladder, words, start, owner, inner = windows(ids, data, offs, rolls, width, levels)
            place = mix(anchor ^ np.uint64(0x51ED))
            mine = np.flatnonzero(place % np.uint64(rounds) == turn)
            rows = np.empty(len(mine), dtype=WINDOW)
            begin = start[mine]
            rows["h"] = form(ladder, rung[mine], a[mine], b[mine], begin, width, rolls[0])
            rows["check"] = span_hash(sums(words, rolls[1]), begin, begin + width, rolls[1]) >> np.uint64(32)
            text = data.tobytes()
            names = np.array([zlib.crc32(text[offs[i] : offs[i + 1]]) for i in range(len(ids))], dtype=np.uint32)
            rows["doc"], rows["name"], rows["at"] = ids[owner[mine]], names[owner[mine]], inner[mine]
            bucket = ((place[mine] // np.uint64(rounds)) % np.uint64(buckets)).astype(np.int32)
            keep, known = settled(rows)
            yield from box.add(bucket[keep], rows[keep])
            if len(known):
                out = np.empty(len(known), dtype=HIT)
                out["doc"], out["name"], out["at"] = rows["doc"][known], rows["name"][known], rows["at"][known]
                yield packed(-1 - (mix(out["doc"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), out)
        yield from box.flush()

    return docs.mapInArrow(run, PACKED)


def settled(rows):
    """(indexes of each window's entries with its least doc_id, indexes of the rest)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, check = np.ascontiguousarray(rows["h"]), np.ascontiguousarray(rows["check"])
    order = np.argsort(h)
    a, b = h[order], check[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((check, h))
        a, b = h[order], check[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    at = np.flatnonzero(np.r_[True, ~same])
    doc = rows["doc"][order]
    low = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(doc))))
    return order[doc == low], order[doc != low]


def by_document(hits: np.ndarray):
    """Batches (doc_id, name, starts): one row for each text of a document, its starts as packed uint32."""
    hits = hits[np.lexsort((hits["name"], hits["doc"]))]
    doc, name, where = (np.ascontiguousarray(hits[c]) for c in ("doc", "name", "at"))
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])]) if len(doc) else np.zeros(0, np.int64)
    stop = np.append(at[1:], len(doc))
    for i in range(0, len(at), 5000):
        part = range(i, min(i + 5000, len(at)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[at[i : i + 5000]], pa.int64()), pa.array(name[at[i : i + 5000]].astype(np.int64)), pa.array([where[at[k] : stop[k]].tobytes() for k in part], pa.binary())], ["doc_id", "name", "starts"])


def repeated(rows: DataFrame) -> DataFrame:
    def run(batches):
        windows_, known = [], []
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (windows_ if bucket >= 0 else known).append(payload)
        rows = np.frombuffer(b"".join(windows_), dtype=WINDOW)
        _, late = settled(rows)
        out = np.empty(len(late), dtype=HIT)
        out["doc"], out["name"], out["at"] = rows["doc"][late], rows["name"][late], rows["at"][late]
        yield from by_document(np.concatenate([out, np.frombuffer(b"".join(known), dtype=HIT)]))

    return dealt(rows).mapInArrow(run, "doc_id long, name long, starts binary")


def dedup(docs: DataFrame, window: int = 13, rounds: int = 5, levels: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word ranges, "start:end" comma-joined), kept (the words left, one space apart)."""
    spark = docs.sparkSession
    docs = keyed_text(docs)
    keyed = docs.where("doc_id is not null")
    found = []
    for turn in range(rounds):
        found.append(cut(repeated(slice_rows(keyed, turn, rounds, window, levels))))
        release(spark)
    starts = reduce(DataFrame.union, found).groupBy("doc_id", "name").agg(F.collect_list("starts").alias("starts"))

    def run(batches):
        for batch in batches:
            out = []
            for text, packs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if not packs:
                    out.append((len(words), 0, "", b" ".join(words).decode()))
                    continue
                at = np.frombuffer(b"".join(packs), dtype=np.uint32).astype(np.int64)
                mark = np.zeros(len(words) + window + 1, dtype=np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                gone = np.cumsum(mark)[: len(words)] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
                left = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                out.append((len(words), int(gone.sum()), ",".join(f"{a}:{b}" for a, b in edge), left.decode()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return docs.withColumn("name", F.crc32("text")).join(starts, ["doc_id", "name"], "left").select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, spans string, kept string")
