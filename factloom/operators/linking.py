"""Candidate pools of a new state: who it may revise, scored, and whether the best one is decisive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import evidence, identity, scope
from factloom.operators import conflict
from factloom.sources.durable import written

#: Fixed values of the pool: its size and the lead that decides.
POOL, LEAD = 8, 0.5


def read_once(c: Callable[[str], Column]) -> dict[str, Column]:
    """What ``weighed`` and ``conflict`` read off one state alone, from its columns ``c``, to be made once a state where states are compared in pairs."""
    entity, span = c("entity").cast("string"), c("span")
    return {
        "subject": identity.norm(entity),
        "parts": identity.attribute_parts(c("attribute")),
        "value_key": identity.state_value(c("attribute"), c("value")),
        "negative": evidence.negative(c("attribute"), c("value").cast("string"), span),
        "revoked": evidence.revoked(span, c("attribute"), c("value")),
        "direct": evidence.directness(span, entity),
        "apart": evidence.has(F.coalesce(span, F.lit("")), evidence.INDEPENDENT),
        "times": evidence.temporal_tokens(span),
        "words": identity.words(span),
        "subject_words": identity.words(entity),
    }


def weighed(pairs: DataFrame) -> DataFrame:
    """pairs of one subject (columns as in ``conflict``) with ``eligible`` and ``score``.

    A pair that isn't the same slot, and isn't a grounded negation of a direct statement with a time in common, stays
    with score 0: it is seen, but decides nothing. Where pairs have a column ``named`` (an effect or a conflict of the
    new state names the old one), such a pair counts too, also of another subject. What ``read_once`` makes is taken
    from columns n_* and o_* of its names where they are there.
    """
    n, o = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"o_{c}"))
    made = {"n": read_once(n), "o": read_once(o)}
    of = lambda p, c: F.col(f"{p}_{c}") if f"{p}_{c}" in pairs.columns else made[p][c]
    subject, alike = of("n", "subject") == of("o", "subject"), identity.parts_compatible(of("n", "parts"), of("o", "parts"))
    slot = subject & alike & conflict.same_scope()
    named = F.coalesce("named", F.lit(False)) if "named" in pairs.columns else F.lit(False)
    direct, apart = of("o", "direct"), of("o", "apart")
    times = F.size(F.array_intersect(of("n", "times"), of("o", "times")))
    crossed = subject & ~slot & of("n", "negative") & (direct > 0) & ~apart & (times > 0)
    shared = evidence.shared(of("n", "words"), of("o", "words"), of("n", "subject_words"), of("o", "subject_words"))
    yes = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    score = (
        yes(subject, 2.0)
        + yes(crossed, 0.75)
        + yes(alike, 1.0)
        + yes(scope.overlaps(n("t0"), n("t1"), o("t0"), o("t1")), 0.5)
        + yes(scope.conditions_overlap(n("cond"), o("cond")), 0.5)
        + F.least(F.lit(1.5), 0.75 * shared)
        + F.least(F.lit(1.5), times.cast("double"))
        + direct
        - yes(apart, 2.0)
    )
    return pairs.select("*", (slot | crossed | named).alias("eligible"), F.when(slot | crossed | named, score).otherwise(0.0).alias("score"))


def pool(pairs: DataFrame, limit: int = POOL) -> DataFrame:
    """The best ``limit`` old states of each new one, from pairs of one subject as ``weighed`` takes them."""
    scored = weighed(pairs).select("n_state_id", "o_state_id", "eligible", "score")
    rank = W.partitionBy("n_state_id").orderBy(F.desc("score"), "o_state_id")
    ranked = scored.select("*", F.row_number().over(rank).cast("long").alias("pool_rank"), F.lead("score").over(rank).alias("next"))
    decisive = (F.col("pool_rank") == 1) & F.col("eligible") & (F.col("score") - F.coalesce("next", F.col("score") - LEAD) >= LEAD)
    return ranked.where(F.col("pool_rank") <= limit).select("n_state_id", "o_state_id", "eligible", F.round("score", 6).alias("score"), "pool_rank", decisive.alias("decisive"))


def roots(aliases: DataFrame, max_rounds: int = 64) -> DataFrame:
    """aliases (state, parent) -> (state, root, hops): chains by pointer doubling, one join a round.

    A chain that ends in no state of its own resolves to that end; a cycle resolves to null (fail closed).
    """
    now = written(aliases.select("state", F.col("parent").alias("root"), F.lit(1).cast("long").alias("hops")))
    for _ in range(max_rounds):
        up = now.select(F.col("state").alias("root"), F.col("root").alias("top"), F.col("hops").alias("more"))
        new = written(now.join(up, "root", "left").select("state", F.coalesce("top", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("top").isNotNull().alias("moved"), (F.col("top") == F.col("state")).alias("loop")))
        now = new.select("state", "root", "hops")
        if new.where("moved and not coalesce(loop, false)").isEmpty():
            break
    else:
        raise RuntimeError(f"alias chains don't end within {max_rounds} rounds of doubling")
    looped = now.join(aliases.select(F.col("state").alias("root"), F.lit(True).alias("inner")), "root", "left")
    return looped.select("state", F.when(F.col("inner").isNull(), F.col("root")).alias("root"), F.when(F.col("inner").isNull(), F.col("hops")).alias("hops"))
