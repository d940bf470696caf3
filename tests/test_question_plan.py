"""Anchors, goals and hints of questions."""

from factloom.operators import question_plan

FACTS = [("Our Mutual Friend", "written_by"), ("Friend", "genre"), ("Dickens", "lives_in"), ("Dickens", "citizens"), ("Acme", "works_for"), (None, "job"), ("", "job"), ("x", None)]
QUESTIONS = [
    (1, "Where does the author of Our Mutual Friend live?"),  # the longest subject; residence by "where", author before the anchor
    (2, "Which country does the author of Dickens come from?"),
    (3, "Friend or Dickens: genre?"),  # of equally long ones the first
    (4, "Acme works with whom?"),  # a name for words outside the families
    (5, None), (6, ""), (7, "Who?"),
]
WANT = {
    1: ("our mutual friend", "residence", ["author"], 2), 2: ("dickens", "citizenship", ["author"], 2), 3: ("friend", "genre", [], 1),
    4: ("acme", "employer", [], 1), 5: (None, None, [], 0), 6: (None, None, [], 0), 7: (None, None, [], 0),
}


def test_plans(spark):
    facts = spark.createDataFrame(FACTS, "subject string, relation string")
    questions = spark.createDataFrame(QUESTIONS + QUESTIONS[:1], "question_id int, text string")
    rows = question_plan.plans(questions, facts).collect()
    assert len(rows) == len(WANT) and {r.question_id: (r.anchor, r.goal, r.hints, r.hops) for r in rows} == WANT
    none = question_plan.plans(questions, facts.limit(0)).collect()
    assert {(r.anchor, r.goal, r.hops) for r in none} == {(None, None, 0)}
    assert question_plan.plans(questions.limit(0), facts).count() == 0
    assert {r.hops for r in question_plan.plans(questions, facts, max_hops=1).collect()} == {0, 1}
