"""Training-order materialisation of token ids as binary shards.

Token streams are cut into sequences of ``length`` ids (the last one of a partition is padded with ``pad_id``). A
keyed Feistel permutation over the number of sequences, with cycle-walking to stay below it, gives each sequence its
global slot; the slot alone says where a sequence lies: shard = slot // per_shard, byte = (slot % per_shard) * stride.
Range partitions of whole shards are sorted by slot and written as fixed-stride files, so a reader goes through a
shard sequentially and can resume at any slot by arithmetic. A shard is written under a task's own name and renamed
when it is whole, so lost executors and repeated tasks leave complete files only. A run writes to an empty folder; one
that holds files already is refused.

Between the passes sequences travel compressed. Counts per partition (not per row) come to the driver. Defined cases:
null or empty text gives the end id alone; rows with null doc_id are kept (their tokens count); equal rows are
separate; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint_dir, chunks, cut, keyed_text, mix, partitions_of
from factloom.llm.tokens import default_path, encoder


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of [0, n): balanced Feistel network on the next even number of bits, walked into range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = 2048, end_id: int = 1, pad_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """part, number (within it), n_tokens, first_doc, ids (zstandard-compressed little-endian uint16 of ``length`` ids)."""
    path = tokenizer or default_path()
    end = end_id.to_bytes(2, "little")

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(path).encode
        buffer, first, rows, stride = bytearray(), None, [], 2 * length

        def out():
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "number", "n_tokens", "first_doc", "ids"])

        for ids, data, offs in chunks(batches):
            text = data.tobytes()
            for i, doc in enumerate(ids):
                own = np.frombuffer(encode(text[offs[i] : offs[i + 1]]), dtype="<u4")
                if len(own) and own.max() > 65535:
                    raise ValueError("the vocabulary doesn't fit 16 bits")
                if not buffer:
                    first = doc
                buffer += own.astype("<u2").tobytes() + end
                at = 0
                while len(buffer) - at >= stride:
                    rows.append((part, number, length, None if first is None else int(first), squeeze(bytes(buffer[at : at + stride]))))
                    number, at, first = number + 1, at + stride, doc
                if at:
                    del buffer[:at]
                if len(rows) >= 512:
                    yield out()
                    rows = []
        if buffer:
            padded = bytes(buffer) + pad_id.to_bytes(2, "little") * (length - len(buffer) // 2)
            rows.append((part, number, len(buffer) // 2, None if first is None else int(first), squeeze(padded)))
        if rows:
            yield out()

    return keyed_text(docs).mapInArrow(run, "part int, number long, n_tokens long, first_doc long, ids binary")


def slotted(rows: DataFrame, key: int, per_shard: int) -> DataFrame:
    """sequence_id (dense), slot, shard and the range of shards (``part``) that writes it.

    ``rows`` must be a table that doesn't change when read again. The ids stay in the JVM.
    """
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    ranges = partitions_of(rows.sparkSession)
    shards = max(1, -(-total // per_shard))

    @F.pandas_udf("struct<sequence_id: long, slot: long>")
    def place(part: pd.Series, number: pd.Series) -> pd.DataFrame:
        index = part.map(before).to_numpy(dtype=np.int64) + number.to_numpy(dtype=np.int64)
        return pd.DataFrame({"sequence_id": index, "slot": feistel(index, total, key)})

    out = rows.withColumn("at", place("part", "number")).select("at.sequence_id", "at.slot", "n_tokens", "first_doc", "ids")
    out = out.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
    return out.withColumn("part", F.least(F.floor(F.col("shard") * ranges / shards), F.lit(ranges - 1)).cast("int"))


def write_shards(rows: DataFrame, folder: str, length: int, per_shard: int) -> DataFrame:
    """Writes shard files to a shared folder (any URI that pyarrow.fs opens); a manifest row for each sequence."""
    stride = 2 * length

    def run(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        expand = zstandard.ZstdDecompressor().decompress
        files, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, handle, name = None, None, None

        def close():
            nonlocal handle
            if handle is not None:
                handle.close()
                if files.get_file_info(name).type == fs.FileType.NotFound:
                    files.move(f"{name}.{attempt}.part", name)
                else:  # another attempt at this task was first; its bytes are the same
                    files.delete_file(f"{name}.{attempt}.part")
                handle = None

        try:
            for b in batches:
                t = b.to_pydict()
                out = []
                for i in range(b.num_rows):
                    if t["shard"][i] != shard:
                        close()
                        shard = t["shard"][i]
                        name = f"{root}/shard-{shard:08d}.bin"
                        handle = files.open_output_stream(f"{name}.{attempt}.part")
                    ids = expand(t["ids"][i])
                    handle.write(ids)
                    out.append((t["slot"][i], shard, (t["slot"][i] % per_shard) * stride, t["sequence_id"][i], t["first_doc"][i], t["n_tokens"][i], zlib.crc32(ids)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["slot", "shard", "byte_offset", "sequence_id", "first_doc", "n_tokens", "ids_crc32"])
            close()
        finally:
            if handle is not None:  # the task failed
                handle.close()
                files.delete_file(f"{name}.{attempt}.part")

    # the slots are known, so ranges need no sampling pass
    dealt = rows.repartitionById(partitions_of(rows.sparkSession), F.col("part")).drop("part").sortWithinPartitions("slot")
    return dealt.mapInArrow(run, "slot long, shard long, byte_offset long, sequence_id long, first_doc long, n_tokens long, ids_crc32 long")


def materialise(docs: DataFrame, folder: str | None = None, key: int = 2024, length: int = 2048, per_shard: int = 256, **options) -> DataFrame:
    """Writes all sequences in training order and returns the manifest (a checkpoint, so files are written once)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    if folder is None:
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        folder = f"{where if ':' in where else 'file://' + where}/shards-{uuid.uuid4().hex}"
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    if files.get_file_info(fs.FileSelector(root)):
        raise FileExistsError(f"{folder} isn't empty: shards of another run would be taken for this one's")
    rows = cut(sequences(docs, length, **options))
    return cut(write_shards(slotted(rows, key, per_shard), folder, length, per_shard))


def read_shard(path: str, length: int = 2048, start: int = 0) -> np.ndarray:
    """Sequences of a shard from number ``start`` on, by arithmetic."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        f.seek(start * 2 * length)
        return np.frombuffer(f.read(), dtype="<u2").reshape(-1, length)
