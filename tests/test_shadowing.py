"""Which current states a question of continuity must not be answered from."""

from datetime import datetime, timedelta

from factloom.operators import shadowing

SCHEMA = "state_id string, entity string, attribute string, field string, value string, span string, observation_id string, sequence_index int, observed_at timestamp, t0 timestamp, t1 timestamp, status string"


def row(i, entity, attribute, value, day, status="CURRENT", span="", obs=None, seq=0, field=None, t0=None, t1=None):
    at = datetime(2024, 1, 1)
    when = lambda n: None if n is None else at + timedelta(days=n)
    return (i, entity, attribute, field, value, span, obs or i, seq, when(day), when(t0), when(t1), status)


ROWS = [
    row("old", "the Ann", "city", "Rome", 1), row("gone", "ann", "city", "Rome", 2, "STALE"),  # a later stale one hides it
    row("ends", "bob", "city", "Oslo", 1, t1=2), row("then", "bob", "city", "Oslo", 5, "STALE", t0=3),  # times don't meet
    row("first", "cy", "job", "cook", 1), row("next", "cy", "job", "baker", 2),  # the later current one stays
    row("words", "dee", "hobby", "chess club", 1, span="dee plays chess club games"), row("other", "dee", "plan", "x", 2, "STALE", "dee left chess club"),  # two words
    row("one", "eve", "hobby", "chess", 1), row("word", "eve", "plan", "chess", 2, "STALE"),  # one word is not enough
    row("s1", "flo", "pet", "cat", 1, span="flo has a cat", obs="o", seq=1), row("s2", "flo", "pet", "cat", 1, span="flo keeps a cat", obs="o", seq=2),  # the earlier span goes
    row("t1", "gus", "pet", "dog", 1, span="gus has a dog", obs="p", seq=1), row("t2", "gus", "pet", "dog", 1, span="gus has a dog", obs="p", seq=2),  # the later of one span goes
    row("m1", "hal", "pet", "cow", 1, span="unrelated to the cow", obs="q", seq=1), row("m2", "hal", "pet", "cow", 1, span="hal has a cow", obs="q", seq=2),  # neither hides the other
    row("none", None, "pet", "cow", 1), row("none2", None, "pet", "cow", 2, "STALE"), row("past", "ivy", "city", "Bonn", 1), row("hist", "ivy", "city", "Bonn", 2, "HISTORICAL"),
]


def test_shadowed(spark):
    states = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.state_id for r in shadowing.shadowed(states, "Does Ann still live in Rome?").collect()} == {"old", "first", "words", "s1", "t2"}
    assert shadowing.shadowed(states, "Where does Ann live?").count() == 0
    assert shadowing.shadowed(states.limit(0), "still there?").count() == 0
