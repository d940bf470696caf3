"""Selectors with wildcards: which states they name, and the one version that they must hit.

A selector names entity, attribute and value of states of its group; a null field stands for any. Selectors are grouped
by which of their fields are null, and each of these patterns is one equi join on the others in normal form.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import identity, scope

FIELDS = ("entity", "attribute", "value")


def _pattern(prefix: str, given: tuple[bool, ...]) -> Column:
    out = F.lit(True)
    for f, g in zip(FIELDS, given, strict=True):
        out = out & (F.col(prefix + f).isNotNull() if g else F.col(prefix + f).isNull())
    return out


def _keyed(df: DataFrame, prefix: str, given: tuple[bool, ...], names: list[str]) -> DataFrame:
    keys = [identity.norm(F.col(prefix + f).cast("string")).alias(k) for f, g, k in zip(FIELDS, given, names, strict=True) if g]
    return df.select("*", *keys)


def patterns(selectors: DataFrame) -> list[tuple[bool, ...]]:
    """Which fields selectors give, of the eight cases those that there are."""
    return sorted(tuple(r) for r in selectors.select(*[F.col(f"sel_{f}").isNotNull().alias(f) for f in FIELDS]).distinct().collect())


def _per_pattern(selectors: DataFrame, join, cases) -> DataFrame:
    names = [f"_k_{f}" for f in FIELDS]
    parts = []
    for given in cases or product((True, False), repeat=3):
        keys = ["group_id", *[k for k, g in zip(names, given, strict=True) if g]]
        parts.append(join(_keyed(selectors.where(_pattern("sel_", given)), "sel_", given, names), given, names, keys).drop(*names))
    return reduce(DataFrame.unionByName, parts)


def matches(selectors: DataFrame, states: DataFrame, cases=None) -> DataFrame:
    """selectors (group_id, sel_entity, sel_attribute, sel_value and others) with the state_id of each state named.

    A row for each match: for selectors whose matches are what is wanted, effects and conflicts. ``cases``: the patterns
    that there are, where that is known.
    """

    def join(own, given, names, keys):
        other = _keyed(states.select("group_id", "state_id", *FIELDS), "", given, names).select(*keys, "state_id")
        return own.join(other, keys)

    return _per_pattern(selectors, join, cases)


def exactly_one(selectors: DataFrame, states: DataFrame, cases=None, own: str | None = None) -> DataFrame:
    """selectors with ``found`` (ONE, NONE, SEVERAL), n_versions and state_id (of ONE: the version's first state).

    states: group_id, state_id, version_id, entity, attribute, value, observation_index, sequence_index. States are
    aggregated by key before the join, so a selector is one row however many states it names. Several states of one
    version are one hit; its first is the least (observation_index, sequence_index, state_id), unknown indexes last.
    ``own``: a column with a version that doesn't count as a hit, the selector's owner; its fields are in own_entity,
    own_attribute and own_value, and it is among the states (where a column own_among is there: if that is true).
    """
    first = F.min(F.struct(F.coalesce("observation_index", F.lit((1 << 63) - 1)), "sequence_index", "state_id"))["state_id"]
    version = F.struct("version_id", "first")

    def join(asking, given, names, keys):
        by_version = _keyed(states, "", given, names).groupBy(*keys, "version_id").agg(first.alias("first"))
        by_key = by_version.groupBy(*keys).agg(F.count("*").alias("n_versions"), F.min(version).alias("least"), F.max(version).alias("most"))
        return asking.join(by_key, keys, "left")

    out = _per_pattern(selectors, join, cases)
    n, one = F.coalesce("n_versions", F.lit(0)), F.col("least.first")
    if own is not None:
        # of two versions, one its owner's, least and most are the two
        itself = scope.selected(*[F.col(f"own_{f}") for f in FIELDS], *[F.col(f"sel_{f}") for f in FIELDS])
        itself = F.coalesce(itself & (F.col("own_among") if "own_among" in selectors.columns else F.lit(True)), F.lit(False))
        n = n - itself.cast("int")
        one = F.when(itself & (F.col("least.version_id") == F.col(own)), F.col("most.first")).otherwise(one)
    found = F.when(n == 0, "NONE").when(n == 1, "ONE").otherwise("SEVERAL")
    return out.select(*selectors.columns, found.alias("found"), n.cast("long").alias("n_versions"), F.when(n == 1, one).alias("state_id"))
