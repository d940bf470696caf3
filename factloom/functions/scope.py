"""Validity intervals, condition scopes and selectors as column expressions.

An interval is half open, [start, end); a null bound is unbounded. Conditions are a sorted array of (key, value) structs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.identity import norm


def _before(end: Column, start: Column) -> Column:
    """The interval that ends at ``end`` is over when the one from ``start`` begins; unbounded never is."""
    return F.coalesce(end <= start, F.lit(False))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return ~_before(a1, b0) & ~_before(b1, a0)


def contains(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """[a0, a1) covers [b0, b1)."""
    return (a0.isNull() | F.coalesce(a0 <= b0, F.lit(False))) & (a1.isNull() | F.coalesce(a1 >= b1, F.lit(False)))


def effective(a0: Column, a1: Column, at: Column) -> Column:
    return (a0.isNull() | (a0 <= at)) & (a1.isNull() | (at < a1))


def semantic_scope(a0: Column, a1: Column, observed: Column) -> tuple[Column, Column]:
    """Bounds without the one that only repeats the time of observation."""
    implied = F.coalesce(a0 == observed, F.lit(False))
    return F.when(~implied, a0), F.when(~(implied & F.coalesce(a1 == observed, F.lit(False))), a1)


def union_scope(starts: Column, ends: Column) -> tuple[Column, Column]:
    """Aggregates: least start and greatest end of a group; an unbounded one absorbs the others."""
    return F.when(~F.bool_or(starts.isNull()), F.min(starts)), F.when(~F.bool_or(ends.isNull()), F.max(ends))


def condition_array(conditions: Column) -> Column:
    """Map -> sorted array of normalised (key, value); null is no condition."""
    pairs = F.transform(F.map_entries(conditions), lambda e: F.struct(norm(e["key"]).alias("key"), norm(e["value"]).alias("value")))
    return F.coalesce(F.array_sort(pairs), F.array().cast("array<struct<key:string,value:string>>"))


def conditions_overlap(a: Column, b: Column) -> Column:
    """Every shared key has one value."""
    return ~F.exists(a, lambda x: F.exists(b, lambda y: (x["key"] == y["key"]) & (x["value"] != y["value"])))


def more_specific(a: Column, b: Column) -> Column:
    """a holds all conditions of b and more."""
    return (F.size(F.array_except(b, a)) == 0) & (F.size(F.array_except(a, b)) > 0)


def selected(entity: Column, attribute: Column, value: Column, sel_entity: Column, sel_attribute: Column, sel_value: Column) -> Column:
    """A selector's null field stands for any; the others are compared in normal form."""
    same = lambda s, x: s.isNull() | (norm(s) == norm(x.cast("string")))
    return same(sel_entity, entity) & same(sel_attribute, attribute) & same(sel_value, value)
