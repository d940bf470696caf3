"""Fill-in-the-middle transformation, cutting texts at unit ends found eight bytes at a time.

A unit is a run of words' leading white space and the word, or the white space that ends a text. The UTF-8 bytes of a
chunk of texts are viewed as 64-bit words; arithmetic on a word marks the bytes that end a unit (a byte that is no
white space before one that is, and the last byte of a text). Counting the marks of each word and summing them up
turns "after k units" into a search of the sums for the word and a select among its eight bytes. Code points are
counted alike, from the marks of bytes that begin one. No shuffle; whole texts.

Where a text is cut follows from a keyed hash of its doc_id, so it doesn't depend on partitions or order.

Defined cases: null or empty text has no units and stays plain; texts that hold a sentinel stay plain; white space
alone is one unit; a null doc_id hashes as the empty string; equal rows get equal results, each its own row; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, keyed_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
ONE, EIGHT, SEVEN = np.uint64(1), np.uint64(8), np.uint64(7)


def every(byte: int) -> np.uint64:
    """A word with ``byte`` in all of its bytes."""
    return np.uint64(0x0101010101010101 * byte)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, zeros after the end (at least one)."""
    out = np.zeros(len(data) // 8 * 8 + 8, dtype=np.uint8)
    out[: len(data)] = data
    return out.view("<u8")


def white(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0x20 or 0x09 to 0x0D; no sum of a byte carries into the next."""
    y = w & LOW
    control = (y + every(0x80 - 0x09)) & ~(y + every(0x80 - 0x0E))
    blank = ~((y ^ every(0x20)) + LOW)
    return (control | blank) & ~w & HIGH


class Marks:
    """Marked bytes (high bits) of a chunk: how many lie before a byte, and where the k-th one is."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.before = np.zeros(len(bits) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(bits), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on bytes before ``at``."""
        word = at >> 3
        below = (ONE << ((at & 7).astype(np.uint64) * EIGHT)) - ONE
        return self.before[word] + np.bitwise_count(self.bits[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, counted from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[word]
        m = self.bits[word]
        for _ in range(7):  # a word has eight marks at most
            m = np.where(left > 0, m & (m - ONE), m)
            left = left - 1
        lowest = m & (~m + ONE)
        return word * 8 + (np.bitwise_count(lowest - ONE) >> 3)


def unit_ends(w: np.ndarray, offs: np.ndarray) -> Marks:
    """Marks on the last byte of every unit of the texts that ``offs`` bounds."""
    space = white(w)
    following = space >> EIGHT
    following[:-1] |= space[1:] << np.uint64(56)
    ends = ~space & following & HIGH
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * EIGHT))
    return Marks(ends)


def code_points(w: np.ndarray) -> Marks:
    """Marks on the bytes that begin a code point (all but 10xxxxxx)."""
    return Marks(~(w & ~(w << ONE)) & HIGH)


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers of the keyed hash of a doc_id."""
    got = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(got[i : i + 4], "big") for i in (0, 4, 8, 12)]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), code points of prefix and middle, and the output text.

    ``fim_percent`` of the texts are transformed, ``spm_percent`` of those put the suffix first.
    """
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches):
        for ids, data, offs in chunks(batches):
            w = as_words(data)
            ends, points = unit_ends(w, offs), code_points(w)
            first = ends.rank(offs[:-1])
            n = ends.rank(offs[1:]) - first
            h = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
            a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            cuts = []
            for units in (np.minimum(a, b), np.maximum(a, b)):
                at = offs[:-1].copy()
                some = np.flatnonzero(units)
                at[some] = ends.select(first[some] + units[some] - 1) + 1
                cuts.append(at)
            lead = points.rank(cuts[0]) - points.rank(offs[:-1])
            mid = points.rank(cuts[1]) - points.rank(cuts[0])
            text = data.tobytes()
            forms, out = [], []
            for i in range(len(ids)):
                begin, c, d, end = int(offs[i]), int(cuts[0][i]), int(cuts[1][i]), int(offs[i + 1])
                whole = text[begin:end]
                if not whole or h[i, 2] % 100 >= fim_percent or p in whole or s in whole or m in whole:
                    forms.append("plain")
                    out.append(whole)
                elif h[i, 3] % 100 < spm_percent:
                    forms.append("spm")
                    out.append(b"".join((s, text[d:end], p, text[begin:c], m, text[c:d])))
                else:
                    forms.append("psm")
                    out.append(b"".join((p, text[begin:c], s, text[d:end], m, text[c:d])))
            plain = np.array([f == "plain" for f in forms])
            arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(lead, pa.int64(), mask=plain), pa.array(mid, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

    return keyed_text(docs).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone (each sentinel occurs once)."""

    def part(text, mark, k):
        return F.split_part(text, F.lit(mark), F.lit(k))

    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), part(output, MIDDLE, 2), part(part(output, MIDDLE, 1), SUFFIX, 2))
    spm = F.concat(part(part(output, MIDDLE, 1), PREFIX, 2), part(output, MIDDLE, 2), part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
