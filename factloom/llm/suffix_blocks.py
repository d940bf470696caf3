"""Byte-substring dedup by blockwise suffix sorting with a difference cover.

Only the first ``length`` bytes of a suffix matter, so a suffix is a window. Windows are dealt to buckets by their
least m-gram (by hash, the leftmost of equal ones; a function of the window's bytes, so equal windows share a bucket and
the place of the m-gram in them), as runs of consecutive windows with one least m-gram, sent as raw bytes. The buckets
are handled in ``rounds`` slices, each a pass over the texts and one shuffle whose files go before the next; a task
holds one bucket at a time. Runs whose m-gram no other run of the bucket has hold no repeated window and leave before
the sort; the other suffixes are sorted by their first 24 bytes; longer ties are settled by the ranks of a difference cover modulo 7, {0, 1, 3}: for any two positions
some shift d < 7 brings both into the cover, whose members' strings of 7, 14, 28 and 56 bytes are ranked beforehand,
and equal ranks over length - d bytes mean equal windows. No hash decides what is removed.

Equal runs of windows of a chunk are sent once, with their first place. Defined cases: null or empty text has no bytes;
texts under ``length`` bytes keep all; extra columns are ignored; empty tables give no rows. Rows that repeat a doc_id
are compared with each other only by start (an equal start is not earlier), and each text has its own spans: ``name``,
a hash of it, tells such rows apart. Rows without a doc_id keep all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Roller, by_bucket, chunks, cut, dealt, keyed_text, mix, partitions_of, release

COVER, PERIOD, PREFIX = (0, 1, 3), 7, 24
GRAM = 24
#: Bytes looked at together, with this many bits for a place in them; the rest of the 64 bits is the m-gram's hash.
SPAN, PLACE_BITS = 1 << 21, 21
META = np.dtype([("doc", "<i8"), ("name", "<i8"), ("gram", "<u8"), ("start", "<u4"), ("bytes", "<u4")])
HIT = np.dtype([("doc", "<i8"), ("name", "<i8"), ("start", "<u4"), ("end", "<u4")])
ROWS = "bucket int, meta binary, data binary"


def runs_of_windows(data, offs, roll: Roller, length: int):
    """(first window, one past the last window, hash of the least m-gram) of runs that share their least m-gram."""
    if len(data) <= SPAN:
        return runs_of_span(data, offs, roll, length)
    # long texts in overlapping spans: every window lies whole in the span that it starts in
    parts, step = [], SPAN - length
    for at in range(0, len(data) - length + 1, step):
        end = min(at + SPAN - 1, len(data))
        first, last, h = runs_of_span(data[at:end], np.clip(offs - at, 0, end - at), roll, length)
        mine = first < step
        parts.append((first[mine] + at, np.minimum(last[mine], step) + at, h[mine]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs_of_span(data, offs, roll: Roller, length: int):
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = roll.prefix(data)
    h = (p[GRAM:] - p[:-GRAM]) * roll.inv[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    bits = PLACE_BITS
    low = (h & ~np.uint64((1 << bits) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    # low[i]: the window that starts at i; it must lie in one document
    place = low & np.uint64((1 << bits) - 1)
    size = np.diff(offs)
    valid = np.zeros(len(low) + 1, dtype=np.int64)
    good = size >= length
    np.add.at(valid, offs[:-1][good], 1)
    np.add.at(valid, (offs[1:] - length + 1)[good], -1)
    inside = np.cumsum(valid)[:-1] > 0
    head = np.zeros(len(low) + 1, dtype=bool)
    head[0] = True
    head[1:-1] = place[1:] != place[:-1]
    head[offs[:-1][offs[:-1] < len(head)]] = True
    first = np.flatnonzero(head[:-1] & inside)
    stops = np.flatnonzero(head | ~np.append(inside, False))
    last = stops[np.searchsorted(stops, first, "right")]
    return first, last, h[place[first].astype(np.int64)]


def named_chunks(batches):
    """chunks() with the names of the texts after the ids."""
    for batch in batches:
        names, at = batch.column(batch.schema.get_field_index("name")).to_numpy(), 0
        for ids, data, offs in chunks([batch]):
            yield ids, names[at : at + len(ids)], data, offs
            at += len(ids)


def slice_rows(docs: DataFrame, turn: int, rounds: int, length: int) -> DataFrame:
    """Runs of one slice of buckets; buckets below 0 hold settled spans (HIT rows in meta)."""
    buckets = partitions_of(docs.sparkSession) * 8

    def run(batches):
        roll = Roller(53)
        kept: dict[int, tuple[list, list]] = {}
        size = 0

        def flush():
            keys = sorted(kept)
            arrays = [pa.array(keys, pa.int32()), pa.array([np.array(kept[k][0], dtype=META).tobytes() for k in keys], pa.binary()), pa.array([b"".join(kept[k][1]) for k in keys], pa.binary())]
            kept.clear()
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "meta", "data"])

        for ids, names, data, offs in named_chunks(batches):
            first, last, h = runs_of_windows(data, offs, roll, length)
            place = mix(h)
            mine = np.flatnonzero(place % np.uint64(rounds) == turn)
            first, last = first[mine], last[mine]
            doc = np.searchsorted(offs, first, "right") - 1
            bucket = (place[mine] // np.uint64(rounds)) % np.uint64(buckets)
            start = first - offs[doc]
            order = np.lexsort((start, ids[doc]))
            gram = h[mine]
            view = data.tobytes()
            seen: dict[bytes, tuple] = {}
            known = []
            for d, n, g, s, f, e, b in zip(ids[doc[order]].tolist(), names[doc[order]].tolist(), gram[order].tolist(), start[order].tolist(), first[order].tolist(), (last[order] + length - 1).tolist(), bucket[order].tolist(), strict=True):
                piece = view[f:e]
                own = (d, s, n)
                first_own = seen.setdefault(piece, own)
                if first_own[:2] != own[:2]:
                    known.append((d, n, s, s + e - f))
                    continue
                if first_own is not own and first_own == own:
                    continue  # the same row again
                m, p = kept.setdefault(b, ([], []))
                m.append((d, n, g, s, e - f))
                p.append(piece)
                size += e - f + META.itemsize
            if known:
                hits = np.array(known, dtype=HIT)
                spot = -1 - (mix(hits["doc"].view(np.uint64) if hits["doc"].flags.c_contiguous else hits["doc"].copy().view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(spot).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([hits[spot == b].tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["bucket", "meta", "data"])
            if size > 12 << 20:
                yield flush()
                size = 0
        if kept:
            yield flush()

    return docs.mapInArrow(run, ROWS)


def words_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n <= 8 bytes at each place as a big-endian number (data must go on for 8 bytes)."""
    view = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    return view[at].astype(np.uint64) >> np.uint64(8 * (8 - n))


def named(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.uint64)
    for k in keys[1:]:
        r = np.unique(k, return_inverse=True)[1].astype(np.uint64)
        out = np.unique(out * np.uint64(int(r.max()) + 1 if len(r) else 1) + r, return_inverse=True)[1].astype(np.uint64)
    return out


def ties(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The windows (ascending) that share their first PREFIX bytes with another, by sorting 8 bytes at a time."""
    at, group = starts, np.zeros(len(starts), dtype=np.uint64)
    for depth in range(0, PREFIX, 8):
        if not len(at):
            break
        key = words_at(data, at + depth, 8)
        order = np.argsort(key) if depth == 0 else np.lexsort((key, group))
        k, g = key[order], group[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])]
        alone = new & np.append(new[1:], True)
        number = np.cumsum(new).astype(np.uint64)
        at, group = at[order][~alone], number[~alone]
    return np.sort(at)


def first_places(data: np.ndarray, at: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each tied window, the least ``place`` of an equal window, by the difference cover's ranks."""
    best = place.copy()
    if not len(at):
        return best
    # cover members whose ranks may be asked for, up to the last whole period of a window
    reach = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + length - PERIOD + 1, -1)
    cover = np.flatnonzero((np.cumsum(reach)[:-1] > 0) & np.isin(np.arange(len(data)) % PERIOD, COVER))
    row = np.full(len(data) + 1, -1, dtype=np.int64)
    row[cover] = np.arange(len(cover))
    rank = {PERIOD: words_at(data, cover, PERIOD)}
    span = PERIOD
    while 4 * span <= length:
        far = row[np.minimum(cover + span, len(data))]
        ok = far >= 0
        double = np.full(len(cover), np.uint64(2**64 - 1))
        if ok.any():
            double[ok] = named(rank[span][ok], rank[span][far[ok]])
        span *= 2
        rank[span] = double
    for d in range(PERIOD):
        pick = np.flatnonzero(np.isin((at + d) % PERIOD, COVER))
        if not len(pick):
            continue
        p, left, keys = at[pick] + d, length - d, []
        for size in sorted(rank, reverse=True):
            while left >= size:
                keys.append(rank[size][row[p]])
                p, left = p + size, left - size
        if left:
            keys.append(words_at(data, p, left))
        # the bytes before the shift, which the cover doesn't see
        keys.append(words_at(data, at[pick], PERIOD))
        name = named(*keys).astype(np.int64)
        low = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, name, place[pick])
        best[pick] = np.minimum(best[pick], low[name])
    return best


def repeated_spans(meta: np.ndarray, pieces: list[bytes], length: int) -> np.ndarray:
    """HIT spans (bytes covered by windows that have an equal one at a smaller (doc, start)) within one block of runs."""
    order = np.lexsort((meta["start"], meta["doc"]))
    known, alone = [], []
    seen: dict[bytes, tuple] = {}
    docs, names, begins = (meta[c].tolist() for c in ("doc", "name", "start"))
    for i in order.tolist():
        own = (docs[i], begins[i], names[i])
        first = seen.setdefault(pieces[i], own)
        if first[:2] != own[:2]:
            known.append(i)
        elif first is own or first != own:  # else the same row again
            alone.append(i)
    alone = np.array(alone, dtype=np.int64)
    _, which, times = np.unique(meta["gram"][alone], return_inverse=True, return_counts=True)
    alone = alone[times[which] > 1]
    m = meta[alone]
    size = m["bytes"].astype(np.int64)
    base = np.zeros(len(m) + 1, dtype=np.int64)
    np.cumsum(size, out=base[1:])
    data = np.frombuffer(b"".join([*(pieces[i] for i in alone), bytes(8)]), dtype=np.uint8)
    count = size - length + 1
    owner = np.repeat(np.arange(len(m)), count)
    begin = np.zeros(len(m) + 1, dtype=np.int64)
    np.cumsum(count, out=begin[1:])
    starts = base[owner] + np.arange(begin[-1]) - begin[owner]
    at = ties(data, starts)
    run = np.searchsorted(base, at, "right") - 1
    place = (np.unique(m["doc"], return_inverse=True)[1][run] << 32) + m["start"][run] + at - base[run]
    late = at[first_places(data, at, place, length) < place]
    out = [np.zeros(0, dtype=HIT)]
    if known:
        k = meta[known]
        x = np.empty(len(k), dtype=HIT)
        x["doc"], x["name"], x["start"], x["end"] = k["doc"], k["name"], k["start"], k["start"] + k["bytes"]
        out.append(x)
    if len(late):
        own = np.searchsorted(base, late, "right") - 1
        new = np.flatnonzero(np.r_[True, (late[1:] != late[:-1] + 1) | (own[1:] != own[:-1])])
        stop = np.append(new[1:], len(late)) - 1
        x = np.empty(len(new), dtype=HIT)
        o = own[new]
        x["doc"], x["name"], x["start"] = m["doc"][o], m["name"][o], m["start"][o] + late[new] - base[o]
        x["end"] = m["start"][o] + late[stop] - base[o] + length
        out.append(x)
    return np.concatenate(out)


def repeated(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        hits = []
        for bucket, rows in by_bucket(batches):  # one block of suffixes at a time
            if bucket < 0:
                hits += [np.frombuffer(meta, dtype=HIT) for meta, _ in rows]
                continue
            meta, pieces = np.concatenate([np.frombuffer(m, dtype=META) for m, _ in rows]), []
            for m, data in rows:
                edge = np.append(0, np.cumsum(np.frombuffer(m, dtype=META)["bytes"], dtype=np.int64)).tolist()
                pieces += [data[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
            hits.append(repeated_spans(meta, pieces, length))
        found = np.concatenate(hits) if hits else np.zeros(0, dtype=HIT)
        found = found[np.lexsort((found["name"], found["doc"]))]
        doc, name = found["doc"], found["name"]
        at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])]) if len(doc) else np.zeros(0, np.int64)
        stop = np.append(at[1:], len(doc))
        body = np.stack([found["start"], found["end"]], axis=1).astype("<u4")
        for i in range(0, len(at), 5000):
            part = range(i, min(i + 5000, len(at)))
            who = [pa.array(x[at[i : i + 5000]].astype(np.int64), pa.int64()) for x in (doc, name)]
            yield pa.RecordBatch.from_arrays([*who, pa.array([body[at[k] : stop[k]].tobytes() for k in part], pa.binary())], ["doc_id", "name", "spans"])

    return dealt(rows).sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, name long, spans binary")


def dedup(docs: DataFrame, length: int = 100, rounds: int = 3) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans ("start:end" in bytes, comma-joined), kept (binary)."""
    spark = docs.sparkSession
    docs = keyed_text(docs).withColumn("name", F.xxhash64("text"))
    keyed = docs.where("doc_id is not null")
    found = []
    for turn in range(rounds):
        found.append(cut(repeated(slice_rows(keyed, turn, rounds, length), length)))
        release(spark)
    spans = reduce(DataFrame.union, found).groupBy("doc_id", "name").agg(F.collect_list("spans").alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for text, packs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                if not packs:
                    out.append((len(data), 0, 0, "", data))
                    continue
                pairs = np.frombuffer(b"".join(packs), dtype="<u4").reshape(-1, 2).astype(np.int64)
                mark = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(mark, pairs[:, 0], 1)
                np.add.at(mark, pairs[:, 1], -1)
                gone = np.cumsum(mark)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
                out.append((len(data), int(gone.sum()), len(edge), ",".join(f"{a}:{b}" for a, b in edge), np.frombuffer(data, np.uint8)[~gone].tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return docs.join(spans, ["doc_id", "name"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept binary")
