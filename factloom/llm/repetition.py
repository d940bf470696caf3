"""Quality rules with suffix-array repetition.

A chunk of documents gets one suffix array over its words (ranks by prefix doubling; only suffixes that still tie are
sorted again; documents never tie with each other). Neighbours in it give the longest common prefixes; a suffix's
longer one is the longest word string that starts there and is found again in its document, so the prefixes that no
longer one covers from the left are the maximal repeats. Their spans are united. A document fails if the repeats of at
least ``least`` words cover more than ``most_covered`` of its words, or if the longest has more than
``most_longest`` of them.

Defined cases: null or empty text has no words and fails the base rule; repeated rows are judged each; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import Roller, chunks, keyed_text, mix, words_of

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, n_covered long, base_failed boolean, kept boolean"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def suffix_lcp(names: np.ndarray, doc: np.ndarray):
    """(suffix array, lcp with the suffix before) of word names; suffixes of other documents have lcp 0."""
    n = len(names)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, word = np.unique(names, return_inverse=True)
    key = doc.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, dtype=np.int64)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    end = np.searchsorted(doc, doc, "right")
    levels = [rank.copy()]
    step = 1
    while True:
        tied = ~new | ~np.append(new[1:], True)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        s = order[at]
        after = s + step
        second = np.where(after < end[s], rank[np.minimum(after, n - 1)] + 1, 0)
        sub = np.lexsort((second, group[at]))
        order[at] = s[sub]
        second = second[sub]
        fresh = np.r_[True, second[1:] != second[:-1]]
        new[at] |= fresh
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = group
        levels.append(rank.copy())
        step *= 2
    lcp = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(doc[order[:-1]] == doc[order[1:]])
    a, b = order[:-1][live], order[1:][live]
    stop_a, stop_b = end[a], end[b]
    for k in range(len(levels) - 1, -1, -1):
        # levels[k] names the first 2^k words (fewer at a document's end)
        room = (a + (1 << k) <= stop_a) & (b + (1 << k) <= stop_b)
        same = room & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a, b = a + (same << k), b + (same << k)
        lcp[live + 1] += same.astype(np.int64) << k
    return order, lcp


def measure(ids, data, offs, roll: Roller, least: int, most_covered: float, most_longest: float):
    _, s, e, at = words_of(data, offs)
    n_words = np.diff(at)
    docs = len(ids)
    doc = np.repeat(np.arange(docs), n_words)
    names = roll.slices(roll.prefix(data), s, e)

    def per_doc(flags, cuts):
        c = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=c[1:])
        return c[cuts[1:]] - c[cuts[:-1]]

    ink = ~_WS[data]
    word_chars = per_doc(ink & ((data & 0xC0) != 0x80), offs)
    n_symbols = per_doc(_SYMBOL[data], offs)
    # lines with a word, equal to an earlier line of the document
    nl = np.zeros(len(data) + 1, dtype=bool)
    nl[:-1] = data == 10
    edge = np.union1d(np.flatnonzero(nl[:-1]) + 1, offs[:-1]).astype(np.int64) if len(data) else np.zeros(0, np.int64)
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data))
    stop = np.where((stop > 0) & nl[np.maximum(stop - 1, 0)], stop - 1, stop)
    stop = np.maximum(stop, edge)
    c = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(ink, out=c[1:])
    worded = c[stop] > c[edge]
    edge, stop = edge[worded], stop[worded]
    line_doc = np.searchsorted(offs, edge, "right") - 1
    line = mix(roll.slices(roll.prefix(data), edge, stop) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), dtype=bool)
    again[first] = False
    n_dup = np.bincount(line_doc[again], minlength=docs)

    order, lcp = suffix_lcp(names, doc)
    longest_at = np.zeros(len(names), dtype=np.int64)
    if len(names):
        longest_at[order] = np.maximum(lcp, np.append(lcp[1:], 0))

    def covered(k):
        """Words in repeats of at least k words (any of them is in a maximal one)."""
        mark = np.zeros(len(names) + 1, dtype=np.int64)
        hit = np.flatnonzero(longest_at >= k)
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + longest_at[hit], -1)
        return np.cumsum(mark)[:-1] > 0

    n_repeat = np.bincount(doc[covered(3)], minlength=docs)
    n_cov = np.bincount(doc[covered(least)], minlength=docs)
    longest = np.zeros(docs, dtype=np.int64)
    if len(names):
        np.maximum.at(longest, doc, longest_at)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (n_cov <= most_covered * n_words) & (longest <= most_longest * n_words)
    return [ids, n_words, word_chars, n_symbols, n_dup, n_repeat, longest, n_cov, failed, kept]


def rules(docs: DataFrame, least: int = 13, most_covered: float = 0.4, most_longest: float = 0.35) -> DataFrame:
    """A row of counts and verdicts for each document."""

    def run(batches):
        roll = Roller(31)
        for ids, data, offs in chunks(batches):
            cols = measure(ids, data, offs, roll, least, most_covered, most_longest)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c.astype(np.int64), pa.int64()) for c in cols[1:8]), *(pa.array(c) for c in cols[8:])], [x.split()[0] for x in SCHEMA.split(", ")])

    return keyed_text(docs).mapInArrow(run, SCHEMA)
