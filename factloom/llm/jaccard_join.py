"""Parity-sketch join: n-gram Jaccard self-join of documents.

Each shingle toggles one bit of a wide parity sketch, so two sketches differ in at most as many bits as the sets
differ in shingles (Hamming distance <= symmetric difference). For size band i a linking pair differs in at most
``k_i`` shingles; the sketch is dealt into more than ``k_i`` parts by shingle hash, and by the pigeonhole principle one
part is equal. With p parts at least p - k_i are equal, so under one global order of parts (most shingles first, then
by code) the first ``k_i + 1`` of both documents share one; the others, which are empty or hold the fewest shingles,
stay at home. A part's bits travel as a 64-bit XOR of bit codes (equal parts have equal codes) and meet per size band.

Meeting joins the classes of a size band into cells (components of the star "class - least class of the same part"), so a
class is in at most two cells however many parts it shares. A cell is dealt to blocks of bounded members and bytes, one
task for each pair of blocks. A first pass compares sketches alone and keeps the members that some partner is near
enough to; their shingle sets go through a second one, where sketches drop pairs whose Hamming distance rules a link
out, the rest is verified exactly and pairs that are joined already are skipped. A task sends a spanning forest of
verified links, at most one row for each member, and no candidate pair is ever a row. The work in one cell grows with
the square of its members of like size (popcounts of 256 bits), what travels with members times blocks.

Defined cases: null or empty text has no shingles and links with nothing (its component is itself); fewer words than
the shingle length make one shingle of the whole sequence; equal sets collapse to one class before any join; rows with
one doc_id and different texts are one vertex, so they share a component; rows without a doc_id are no vertex, so they
have no component and one_of_each keeps them all. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import PACKED, Outbox, Roller, batches_of, by_bucket, chunks, cut, dealt, keyed_text, mix, partitions_of, release, words_of
from factloom.llm.components import components, stars

KEY = np.dtype([("key", "<u8"), ("node", "<i8")])
SEED = 11
#: Members and bytes of sketches or shingle sets of a block; a task holds two blocks.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Rows (of about 40 bytes) up to which the classes whose sets are wanted are broadcast; beyond, they are joined by a shuffle.
SMALL = 300_000


def shingle_sets(batches, size: int):
    """(ids, first shingle of each document plus total, shingle hashes sorted and distinct within each document)."""
    roll = Roller(SEED)
    step = [np.uint64(x) for x in np.random.default_rng(SEED + 1).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
    for ids, data, offs in chunks(batches):
        data, s, e, at = words_of(data, offs, lower=True)
        w = roll.slices(roll.prefix(data), s, e)
        n = np.diff(at)
        acc = np.zeros(max(0, len(w) - size + 1), dtype=np.uint64)
        for i in range(size):
            acc = mix(acc + w[i : len(w) - size + 1 + i] * step[i]) if len(acc) else acc
        sets = []
        for d in range(len(ids)):
            if n[d] >= size:
                sets.append(np.unique(acc[at[d] : at[d + 1] - size + 1]))
            elif n[d]:
                x = np.uint64(0x9E37 + int(n[d]))[None]
                for v in w[at[d] : at[d + 1]]:
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + v)
                sets.append(x)
            else:
                sets.append(w[:0])
        cuts = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in sets], out=cuts[1:])
        yield ids, cuts, np.concatenate(sets) if sets else w[:0]


def class_ids(cuts, hashes):
    """A 64-bit name of each set, from the sum of mixed hashes and the size."""
    c = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5DEADBEEF)), out=c[1:])
    return mix(c[cuts[1:]] - c[cuts[:-1]] + np.diff(cuts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def band_edges(num: int, den: int, limit: int = 1 << 31, power: int = 2) -> np.ndarray:
    """Least size of each band: a linking pair is in one band or in neighbours. The first size that can differ starts it."""
    first = 1
    while 2 * first * (den - num) // (den + num) == 0:
        first += 1
    out = [first]
    while out[-1] < limit:
        out.append(int(out[-1] * (den / num) ** power) + 1)
    return np.array(out, dtype=np.int64)


def differences(edges, num: int, den: int) -> np.ndarray:
    """k for each band: the largest symmetric difference of a linking pair whose larger set is in it."""
    return 2 * (edges[1:] - 1) * (den - num) // (den + num)


def node_of(cls: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A class in the role of a member of a size band."""
    return mix(cls.view(np.uint64) + mix(band.astype(np.uint64) + np.uint64(0xB0B))).view(np.int64)


def bands_of(n: np.ndarray, num: int, den: int):
    """For the set's own band and the next: (band, whether the set can have a partner in it)."""
    edges = band_edges(num, den)
    band = np.searchsorted(edges, n, "right") - 1
    for up in (0, 1):
        # a set just below the first band has no band of its own, but can match a larger one in it
        use = (band + up >= 0) & (n * den >= edges[np.minimum(band + up, len(edges) - 1)] * num)
        yield np.where(use, np.minimum(band + up, len(edges) - 2), 0), use


def sketch_keys(cuts, hashes, cls, num: int, den: int):
    """Structured rows (key, node): the parity code of each part, for the set's band and, where it can match, the next."""
    most = differences(band_edges(num, den), num, den)
    parts = most + 3 * most // 10 + 2
    n = np.diff(cuts)
    code = mix(hashes + np.uint64(0x1234567))  # the code of the shingle's bit
    out = []
    for b, use in bands_of(n, num, den):
        p = parts[b]
        owner = np.repeat(np.arange(len(n)), n)
        keep = use[owner]
        owner, h, c = owner[keep], hashes[keep], code[keep]
        base = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(np.where(use, p, 0), out=base[1:])
        cell = base[owner] + ((h >> np.uint64(20)) % p[owner].astype(np.uint64)).astype(np.int64)
        held = np.bincount(cell, minlength=base[-1])
        order = np.argsort(cell, kind="stable")
        sums = np.zeros(base[-1], dtype=np.uint64)
        full = np.flatnonzero(held)
        if len(order):
            at = np.cumsum(held[full]) - held[full]
            sums[full] = np.bitwise_xor.reduceat(c[order], at)
        who = np.repeat(np.arange(len(n)), np.where(use, p, 0))
        part = np.arange(base[-1]) - base[who]
        key = mix(sums + mix(b[who].astype(np.uint64) * np.uint64(1 << 32) + part.astype(np.uint64) + np.uint64(77)))
        rank = ((255 - np.minimum(held, 255)).astype(np.uint64) << np.uint64(56)) | (key >> np.uint64(8))
        order = np.lexsort((rank, who))  # the parts of a document stay together
        ahead = order[part <= most[b[who]]]
        rows = np.empty(len(ahead), dtype=KEY)
        rows["key"], rows["node"] = key[ahead], node_of(cls[who[ahead]], b[who[ahead]])
        out.append(rows)
    return np.concatenate(out)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, cls, sketch (four to eight bits a shingle)."""

    def run(batches):
        for ids, cuts, hashes in shingle_sets(batches, size):
            own = [sketches([hashes[a:b]], width(b - a)).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(class_ids(cuts, hashes), pa.int64()), pa.array(own, pa.binary())], ["doc_id", "n_shingles", "cls", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls long, sketch binary")


def key_rows(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    buckets = partitions_of(docs.sparkSession) * 8

    def run(batches):
        box = Outbox(buckets)
        for _, cuts, hashes in shingle_sets(batches, size):
            cls = class_ids(cuts, hashes)
            _, one = np.unique(cls, return_index=True)  # equal sets of a chunk send their keys once
            keep = np.zeros(len(cls), dtype=bool)
            keep[one] = True
            n = np.diff(cuts)
            mask = np.repeat(keep, n)
            kept_cuts = np.zeros(int(keep.sum()) + 1, dtype=np.int64)
            np.cumsum(n[keep], out=kept_cuts[1:])
            rows = sketch_keys(kept_cuts, hashes[mask], cls[keep], num, den)
            yield from box.add((rows["key"] % np.uint64(buckets)).astype(np.int32), rows)
        yield from box.flush()

    return docs.mapInArrow(run, PACKED)


def met(keys: DataFrame) -> DataFrame:
    """Edges (a, b) that join the nodes of each shared key, one bucket of keys at a time."""

    def run(batches):
        for _, payloads in by_bucket(batches):
            rows = np.frombuffer(b"".join(x for (x,) in payloads), dtype=KEY)
            order = np.argsort(rows["key"])
            k = rows["key"][order]
            alike = np.zeros(len(k) + 1, dtype=bool)
            alike[1:-1] = k[1:] == k[:-1]
            rows = rows[order[alike[1:] | alike[:-1]]]  # most keys are alone
            if not len(rows):
                continue
            k, node = rows["key"], np.ascontiguousarray(rows["node"])
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            hub = np.repeat(np.minimum.reduceat(node, at), np.diff(np.r_[at, len(k)]))
            a, b = stars(node, hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt(keys).sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def width(n: int) -> int:
    """Bits of the sketch of n shingles."""
    return min(1 << 17, max(256, 4 << (max(1, int(n)) - 1).bit_length()))


def sketches(sets: list, bits: int) -> np.ndarray:
    """Parity sketches of ``bits`` bits, a row of 64-bit words for each set."""
    out = np.empty((len(sets), bits // 64), dtype=np.uint64)
    for i, h in enumerate(sets):
        odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
    return out


def near_ones(size, own, full, num: int, den: int, label=None):
    """(x, partners) for members in order of size: the later ones whose size and sketch allow a link, in other labels."""
    across = own.min() != own.max()
    thin = np.ascontiguousarray(np.bitwise_xor.reduce(full.reshape(len(size), -1, 4), axis=1).T)
    stop = np.searchsorted(size * num, size * den, "right")
    for x in range(len(size)):
        lo, hi = x + 1, int(stop[x])
        if lo >= hi:
            continue
        room = (size[lo:hi] + size[x]) * (den - num)
        apart = np.zeros(hi - lo, dtype=np.int64)
        for row in thin:
            apart += np.bitwise_count(row[lo:hi] ^ row[x])
        near = apart * (den + num) <= room
        if label is not None:
            near &= label[lo:hi] != label[x]
        if across:
            near &= own[lo:hi] != own[x]
        y = np.flatnonzero(near)
        if len(y):
            apart = np.bitwise_count(full[lo + y] ^ full[x]).sum(axis=1, dtype=np.int64)
            y = lo + y[apart * (den + num) <= room[y]]
        if len(y):
            yield x, y


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def forest(cls: np.ndarray, own: np.ndarray, sets: list, num: int, den: int):
    """Verified links that join the members of a block (or of two, across them) as far as links go.

    Members go by size, so partners are a range; 256 bits, then about eight bits a shingle, rule pairs out.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    cls, own, size, sets = cls[order], own[order], size[order], [sets[i] for i in order]
    full = sketches(sets, min(1 << 15, 2 * width(size.mean())))
    label, out = np.arange(len(sets)), []
    for x, partners in near_ones(size, own, full, num, den, label):
        for k in partners.tolist():
            if label[k] != label[x] and linked(sets[x], sets[k], num, den):
                out.append((int(cls[x]), int(cls[k])))
                label[label == label[k]] = label[x]
        if len(out) == len(sets) - 1:
            break
    return out


def hopeful(cls: np.ndarray, own: np.ndarray, size: np.ndarray, own_sketches: list, num: int, den: int) -> np.ndarray:
    """The members of a block (or of two, across them) that have a partner whose sketch allows a link."""
    order = np.argsort(size, kind="stable")
    words = min(len(x) for x in own_sketches) // 8
    full = np.empty((len(size), words), dtype=np.uint64)
    for i, k in enumerate(order):
        full[i] = np.bitwise_xor.reduce(np.frombuffer(own_sketches[k], dtype="<u8").reshape(-1, words), axis=0)
    mark = np.zeros(len(size), dtype=bool)
    for x, partners in near_ones(size[order], own[order], full, num, den):
        mark[x] = True
        mark[partners] = True
    return cls[order][mark]


def in_cells(classes: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """cls, cell, first_doc, size, sketch: a row for each band in which a class has met another."""

    def run(batches):
        for batch in batches:
            cls, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for b, use in bands_of(n, num, den):
                where = pa.array(np.flatnonzero(use))
                yield pa.RecordBatch.from_arrays([pa.array(node_of(cls, b)).take(where), *(batch.column(i).take(where) for i in range(3))], ["node", "cls", "first_doc", "size"])

    nodes = classes.select("cls", "first_doc", "size").mapInArrow(run, "node long, cls long, first_doc long, size long")
    return nodes.join(cells, "node").select("cls", F.col("label").alias("cell"), "first_doc", "size").join(classes.select("cls", "sketch"), "cls")


def dealt_to_blocks(rows: DataFrame, payload_bytes, kind: str) -> DataFrame:
    """cls, cell, blocks, own and the other columns of members of cells with more than one member."""
    heavy = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum(payload_bytes).alias("weight")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_BYTES)).cast("int")
    return rows.join(heavy, "cell").select("cls", "cell", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("own"), "first_doc", *([kind] if kind else []))


def block_pairs(rows: DataFrame, payload: str, work, schema: str) -> DataFrame:
    """``work({cls: (own, payload)})`` for each pair of blocks of a cell, one at a time in a task."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("cls", "cell", "own", payload, other).select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", payload)

    def run(batches):
        held, key = {}, None
        for batch in batches:
            place = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            own, cls, data = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            for r, here in enumerate(place):
                if here != key:
                    if len(held) > 1:
                        yield from work(held)
                    held, key = {}, here
                if cls[r] not in held:  # repeated rows
                    held[cls[r]] = (own[r], data[r].as_py())
        if len(held) > 1:
            yield from work(held)

    return rows.repartition(partitions_of(rows.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, schema)


def with_hope(member: DataFrame, num: int, den: int) -> DataFrame:
    """cls, cell of the members that some partner's sketch is near enough to."""

    def work(held):
        one = list(held.values())
        size = np.array([x["size"] for _, x in one], dtype=np.int64)
        found = hopeful(np.fromiter(held, np.int64, len(held)), np.array([o for o, _ in one]), size, [x["sketch"] for _, x in one], num, den)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["cls"])

    rows = dealt_to_blocks(member.select("cls", "cell", "first_doc", F.struct("size", "sketch").alias("data")), F.octet_length("data.sketch"), "data")
    return block_pairs(rows, "data", work, "cls long").distinct()


def links_in_cells(docs: DataFrame, member: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Spanning links (a, b) of every cell. member: cls, cell, first_doc, size."""
    placed = cut(dealt_to_blocks(member, F.col("size") * 8, "").select(F.col("first_doc").alias("doc_id"), "cls", "cell", "blocks", "own"))
    texts = docs.join(F.broadcast(placed) if placed.count() <= SMALL else placed, "doc_id")

    def with_sets(batches):
        for batch in batches:
            at = 0
            for ids, cuts, hashes in shingle_sets([batch], size):
                part = batch.slice(at, len(ids))
                at += len(ids)
                # a repeated doc_id brings texts of other classes too
                mine = np.flatnonzero(class_ids(cuts, hashes) == part.column("cls").to_numpy())
                where = pa.array(mine)
                cols = [part.column(c).take(where) for c in ("cls", "cell", "blocks", "own")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([hashes[cuts[i] : cuts[i + 1]].tobytes() for i in mine], pa.binary())], ["cls", "cell", "blocks", "own", "shingles"])

    def work(held):
        edges = forest(np.fromiter(held, np.int64, len(held)), np.array([o for o, _ in held.values()]), [np.frombuffer(x, np.uint64) for _, x in held.values()], num, den)
        if edges:
            a, b = stars(*(np.array(x, dtype=np.int64) for x in zip(*edges, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sets = texts.select("doc_id", "text", "cls", "cell", "blocks", "own").mapInArrow(with_sets, "cls long, cell long, blocks int, own int, shingles binary")
    return block_pairs(sets, "shingles", work, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links of Jaccard >= num/den)."""
    spark = docs.sparkSession
    every = keyed_text(docs)
    docs = every.where("doc_id is not null")
    prof = cut(profiles(docs, size))
    classes = cut(prof.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")))
    # a checkpoint between the two Python steps, so that a task never holds two workers
    cells = components(cut(met(key_rows(docs, size, num, den))))
    release(spark)
    member = cut(in_cells(classes, cells, num, den))
    # a doc_id with several texts is one vertex
    several = cut(prof.groupBy("doc_id").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least <> most").select("doc_id", "least"))
    bound = prof.join(several, "doc_id").where("n_shingles > 0").select(F.col("cls").alias("a"), F.col("doc_id"))
    bound = bound.join(bound.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").select("a", "b")
    with batches_of(spark, 256):
        hope = cut(with_hope(member, num, den))
        links = cut(links_in_cells(docs, member.join(hope, "cls").drop("sketch"), size, num, den).union(bound))
    release(spark)
    labels = components(links)
    # from classes to documents
    named = cut(classes.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").select("cls", "first_doc", F.coalesce("label", "cls").alias("label")))
    least = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_class = cut(named.join(least, "label").select("cls", "component_id"))
    known = prof.where("n_shingles > 0").join(by_class, "cls").select("doc_id", "n_shingles", "component_id")
    shared = several.join(known, "doc_id", "left").groupBy("doc_id").agg(F.min("component_id").alias("shared"))
    bare = prof.where("n_shingles = 0").join(shared, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("shared", "doc_id").alias("component_id"))
    nameless = profiles(every.where("doc_id is null"), size)
    return known.union(bare).union(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents of the least doc_id in each component, all columns kept.

    A row without a doc_id goes by a number above 2**62 made of its text, so it stays only where no document with a
    doc_id is linked with it; of such rows with equal words one stays. Rows without words stay.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))
    named = docs.select(number.alias("doc_id"), "text")
    keep = jaccard_components(named, size, num, den).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    worded = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    nameless = docs.where("doc_id is null")
    every = docs.where("doc_id is not null").unionByName(nameless.where(worded).dropDuplicates(["text"])).unionByName(nameless.where(~worded))
    return every.join(keep, number == keep["kept"], "left_semi")
