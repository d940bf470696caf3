"""Hierarchical multi-length packing.

Documents are routed to context tiers (powers of two up to ``window``) by length; whole windows of longer ones leave
at once. Each tier opens a sequence with its own piece and fills the gap from shorter tiers, the longest that fits
first, the last one cut. What is left at the end of a partition is laid end to end into windows and then into powers
of two, so no sequence needs padding. Sequences of a batch are dealt to step groups, longest first, to the lightest
group, which balances their tokens.

It works within the partitions of its input, in bounded buffers and without a shuffle; sequence ids start with the
partition number and are the same when a lost task runs again. Defined cases: null or empty text is the end id alone;
equal rows and rows without a doc_id are packed each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import chunks, keyed_text
from factloom.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])


class Packer:
    """Takes documents (id, id bytes) and gives finished sequences: lists of (doc, start, length, ids, doc_tokens)."""

    def __init__(self, window: int, least: int, buffered: int):
        self.window, self.buffered = window, buffered
        self.tiers = [window >> i for i in range(window.bit_length()) if window >> i >= least]
        self.queues = {t: deque() for t in self.tiers}
        self.held = 0

    def tier(self, n: int) -> int:
        return next((t for t in reversed(self.tiers) if t >= n), self.window)

    def add(self, doc, ids: bytes):
        n, w = len(ids) // 4, self.window
        at = 0
        while n - at >= w:
            yield [(doc, at, w, ids[4 * at : 4 * (at + w)], n)]
            at += w
        if at < n:
            self.put((doc, at, n - at, ids[4 * at :], n))
        if self.held >= self.buffered:
            yield from self.fill()

    def put(self, piece):
        self.queues[self.tier(piece[2])].append(piece)
        self.held += piece[2]

    def fill(self):
        """Packs the tiers until the shortest one holds no more than a few windows' tokens for later gaps."""
        for t in self.tiers:
            queue = self.queues[t]
            while queue:
                if self.held < t:
                    return
                seq, gap = [queue.popleft()], t
                gap -= seq[0][2]
                self.held -= seq[0][2]
                while gap:
                    piece = self.take(gap)
                    self.held -= piece[2]
                    seq.append(piece)
                    gap -= piece[2]
                yield seq

    def take(self, gap: int):
        """The next piece of the longest tier that fits whole, else a cut one of the shortest tier that holds any."""
        for t in self.tiers:
            if self.queues[t] and self.queues[t][0][2] <= gap:
                return self.queues[t].popleft()
        t = next(t for t in reversed(self.tiers) if self.queues[t])
        return self.split(self.queues[t].popleft(), gap)

    def split(self, piece, n: int):
        doc, at, size, ids, total = piece
        rest = (doc, at + n, size - n, ids[4 * n :], total)
        self.queues[self.tier(rest[2])].appendleft(rest)
        return (doc, at, n, ids[: 4 * n], total)

    def finish(self):
        yield from self.fill()
        while self.held:
            room = min(self.window, 1 << (self.held.bit_length() - 1))
            seq = []
            while room:
                piece = self.take(room)
                self.held -= piece[2]
                room -= piece[2]
                seq.append(piece)
            yield seq


def balanced(sequences: list, steps: int) -> list[int]:
    """A group for each sequence: longest first, each to the group with the fewest tokens so far."""
    sizes = [sum(p[2] for p in s) for s in sequences]
    load = [(0, g) for g in range(steps)]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-sizes[i], i)):
        total, g = heapq.heappop(load)
        out[i] = g
        heapq.heappush(load, (total + sizes[i], g))
    return out


def pack(docs: DataFrame, window: int = 2048, least: int = 256, end_id: int = 1, step_tokens: int = 16 * 2048, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece, with its ids. ``step_tokens``: about how many tokens a step group holds."""
    path = tokenizer or default_path()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        encode = encoder(path).encode
        packer, number, groups, waiting = Packer(window, least, 64 * window), 0, 0, []

        def out(sequences):
            nonlocal number, groups
            steps = max(1, round(sum(p[2] for s in sequences for p in s) / step_tokens))
            rows = []
            for seq, g in zip(sequences, balanced(sequences, steps), strict=True):
                at, size = 0, sum(p[2] for p in seq)
                for p in seq:
                    rows.append((p[0], p[1], p[2], p[3], p[4], base + number, at, size, base + groups + g))
                    at += p[2]
                number += 1
            groups += steps
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        def all_sequences():
            for ids, data, offs in chunks(batches):
                text = data.tobytes()
                for i, doc in enumerate(ids):
                    yield from packer.add(None if doc is None else int(doc), encode(text[offs[i] : offs[i + 1]]) + end)
            yield from packer.finish()

        for seq in all_sequences():
            waiting.append(seq)
            if len(waiting) == 256:
                yield out(waiting)
                waiting = []
        if waiting:
            yield out(waiting)

    return keyed_text(docs).mapInArrow(run, SCHEMA)
