"""Normal forms and content-addressed ids of state slots (all JVM-side)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the identity rules.
ATTRIBUTE_GRAMMAR = "a an at by for has have in is of on the to with".split()
ATTRIBUTE_QUALIFIERS = "city country field location name place position sport".split()
ATTRIBUTE_ALIASES = {"job": "employment_role", "occupation": "employment_role", "current_job": "employment_role", "current_role": "employment_role", "job_title": "employment_role", "free_on": "availability", "used_tool": "tool_use", "tool_experience": "tool_use"}
WORDS = r"[\p{L}\p{M}\p{N}_]+"


def words(c: Column) -> Column:
    """Lower-cased words (letters, marks, digits, underscore) in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORDS), F.lit(0))


def literal_set(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def norm(c: Column) -> Column:
    """Lower case, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def field_id(c: Column) -> Column:
    """Words of a field name joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s_-]+", "_"), "^_+|_+$", "")


def attribute_id(c: Column) -> Column:
    """The field id, or what it is an alias of."""
    names = F.create_map(*[F.lit(x) for pair in ATTRIBUTE_ALIASES.items() for x in pair])
    return F.coalesce(names[field_id(c)], field_id(c))


def attribute_tokens(c: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "[_-]", " ")
    return F.array_except(F.array_distinct(words(spaced)), literal_set(ATTRIBUTE_GRAMMAR))


def attribute_parts(c: Column) -> Column:
    """What compatibility is judged by, to be made once a row where rows are compared in pairs."""
    return F.struct(attribute_id(c).alias("id"), norm(c).alias("norm"), attribute_tokens(c).alias("tokens"))


def attribute_keys(parts: Column) -> Column:
    """Compatible attributes share one of these; those that share one need not be compatible."""
    either = F.when(F.size(parts["tokens"]) == 0, F.array(parts["norm"])).otherwise(parts["tokens"])
    return F.array_distinct(F.array_compact(F.concat(F.array(parts["id"]), either)))


def parts_compatible(a: Column, b: Column) -> Column:
    """Equal ids, equal token sets, or one set within the other with a shared token that is no mere qualifier."""
    x, y = a["tokens"], b["tokens"]
    shared = F.array_intersect(x, y)
    own = F.size(F.array_except(shared, literal_set(ATTRIBUTE_QUALIFIERS))) > 0
    within = (F.size(shared) == F.size(x)) | (F.size(shared) == F.size(y))
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    equal = (F.size(shared) == F.size(x)) & (F.size(shared) == F.size(y))
    return (a["id"] == b["id"]) | F.when(empty, a["norm"] == b["norm"]).otherwise(equal | (own & within))


def attributes_compatible(a: Column, b: Column) -> Column:
    """``parts_compatible`` of two attributes."""
    return parts_compatible(attribute_parts(a), attribute_parts(b))


def state_value(field: Column, value: Column) -> Column:
    """Normal form of a value; of an availability, without the words that only repeat it."""
    v = norm(value.cast("string"))
    bare = norm(F.regexp_replace(v, r"\b(?:free|available)\b", " "))
    return F.when(attribute_id(field) == "availability", norm(F.regexp_replace(bare, r"^(?:on|at|for)\s+", ""))).otherwise(v)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields in order of their names, nulls written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(prefix: str, payload: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.sha2(payload, 256))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based (SHA-1) UUID, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def confidence(c: Column) -> Column:
    """Within [0, 1]; what is no number is 0.5."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.5))))


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("1", "true", "yes"), F.lit(False))
