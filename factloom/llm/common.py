"""Kernels shared by the training-data operators: Arrow text access, word and window hashes, packed exchanges.

Rolling hashes are polynomial over 64-bit words (random byte table, odd base), so the hash of any slice comes from
two prefix sums. Names that decide what is removed use two independent hashes (128 bits).
"""

from __future__ import annotations

import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles; a longer single text is a pass of its own.
CHUNK_BYTES = 1 << 20
ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class Roller:
    """Prefix polynomial hash of byte arrays; ``slices`` hashes [start, end) slices."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(1, 2**64, 256, dtype=np.uint64)
        base = int(r.integers(0, 2**62)) * 4 + 5
        self.base, self.inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        self.pow = self.inv = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.pow) < n:
            ones = np.full(n, self.base, dtype=np.uint64)
            ones[0] = 1
            self.pow = np.multiply.accumulate(ones)
            ones[1:] = self.inverse
            self.inv = np.multiply.accumulate(ones)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        self.powers(n)
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.table[data] * self.pow[: n - 1], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64))


def chunks(batches, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK_BYTES):
    """(ids, data bytes, offsets) of slices of Arrow batches; null text is empty. ids are int64, or objects where some are None."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(text_col))
        if text.null_count:
            text = text.fill_null("")
        text = text.cast(pa.large_binary())
        ids = batch.column(batch.schema.get_field_index(id_col))
        ids = np.array(ids.to_pylist(), dtype=object) if ids.null_count else ids.to_numpy(zero_copy_only=False)
        n = len(text)
        if not n:
            continue
        offs = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            j = min(j, n)
            yield ids[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
    pa.default_memory_pool().release_unused()


def words_of(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+``: (data, starts, ends, first word of each document plus the total)."""
    if lower:
        data = _LOWER[data]
    ink = np.zeros(len(data) + 1, dtype=bool)
    ink[:-1] = ~_WS[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offs] = True
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | first))
    ends = np.flatnonzero(before & (~ink | first))
    return data, starts, ends, np.searchsorted(starts, offs)


def packed(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a structured array, one binary payload for each bucket."""
    order = np.argsort(bucket, kind="stable")
    b, rows = bucket[order], np.ascontiguousarray(rows[order])
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    cut = np.r_[at, len(b)]
    payload = [rows[cut[i] : cut[i + 1]].tobytes() for i in range(len(at))]
    return pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32), pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])


PACKED = "bucket int, payload binary"


class Outbox:
    """Gathers structured rows and gives packed batches of about ``limit`` bytes."""

    def __init__(self, buckets: int, limit: int = 12 << 20):
        self.buckets, self.limit, self.kept, self.size = buckets, limit, [], 0

    def add(self, bucket: np.ndarray, rows: np.ndarray):
        self.kept.append((bucket.astype(np.int32), rows))
        self.size += rows.nbytes
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self):
        if self.kept:
            out = packed(np.concatenate([b for b, _ in self.kept]), np.concatenate([r for _, r in self.kept]))
            self.kept, self.size = [], 0
            yield out


def by_bucket(batches):
    """(bucket, rows without the bucket) of partitions sorted by bucket, so that one bucket is held at a time."""
    held, name = [], None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for bucket, *rest in zip(*cols, strict=True):
            if bucket != name:
                if held:
                    yield name, held
                held, name = [], bucket
            held.append(rest)
    if held:
        yield name, held


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, column: str = "bucket") -> DataFrame:
    """One shuffle by bucket, to spark.sql.shuffle.partitions partitions."""
    return df.repartition(partitions_of(df.sparkSession), F.col(column))


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in spark.checkpoint.dir; sets a local one only where it is unset (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: lineage ends, lost executors don't matter."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the actions inside, where rows are large."""
    before = spark.conf.get(ROWS_PER_BATCH)
    spark.conf.set(ROWS_PER_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_PER_BATCH, before)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text"):
    """A 64-bit name of a row from its doc_id and text; a null doc_id is left out."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, find) -> DataFrame:
    """The rows of ``docs`` that ``find`` doesn't name, all columns kept.

    ``find`` gets (doc_id, text) rows whose doc_id is the row's key, so rows without a doc_id and several texts of one
    doc_id are judged each for itself; it returns rows with that doc_id.
    """
    named = find(docs.select(row_key().alias("doc_id"), "text")).select(F.col("doc_id").alias("key")).distinct()
    return docs.join(named, row_key() == named["key"], "left_anti")


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so extra columns (also with clashing names) never matter.

    Texts are long: where nobody has set how many rows an Arrow batch holds, the session is set to 1,000, for bounded
    memory; a number that has been set, whatever it is, stays.
    """
    conf = docs.sparkSession.conf
    if ROWS_PER_BATCH not in conf.getAll:
        conf.set(ROWS_PER_BATCH, "1000")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
