"""Column helpers for normalised text, token sets and content-addressed ids (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}_]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def content_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a unit separator; null parts count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def sentences(c: Column) -> Column:
    """Trimmed pieces that end with . ! ? or a line end."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
