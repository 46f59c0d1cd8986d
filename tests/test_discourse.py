import pytest
from pyspark.sql import functions as F

from turnlake.operators import discourse as ds
from turnlake.operators import intervals as iv

Q = "क्या यह सही है"
CASES = {
    "teacher goes on": ([("T", 0, 10), ("T", 11, 13), ("S1", 16, 20)], [(0, 10, Q)], [(True, 6.0)]),
    "nested answer": ([("T", 0, 20), ("S1", 5, 7), ("S2", 23, 28)], [(0, 20, Q)], [(True, 3.0)]),
    "already talking": ([("T", 0, 20), ("S1", 18, 25)], [(0, 20, Q)], [(True, 0.0)]),
    "snapped boundary": ([("T", 0, 10), ("S1", 10, 15)], [(0, 10, Q)], [(True, None)]),
    "one utterance, three turns": ([("T", 0, 10), ("T", 10, 20), ("T", 20, 30), ("S1", 32, 36)], [(0, 30, Q)], [(True, 2.0)]),
    "answer during the run": ([("T", 0, 10), ("T", 10, 30), ("S1", 25, 35)], [(0, 30, Q)], [(True, 0.0)]),
    "statement, then question": ([("T", 0, 10), ("T", 10, 20), ("T", 21, 25), ("S1", 27, 31)],
                                 [(0, 30, "आज हम"), (10, 15, Q)], [(True, 7.0)]),
    "too late": ([("T", 0, 10), ("S1", 26, 30)], [(0, 10, Q)], [(False, None)]),
    "statement": ([("T", 0, 10), ("S1", 12, 14)], [(0, 10, "ठीक है")], []),
}


@pytest.mark.parametrize("split", [False, True])
def test_questions_answers_and_waits(make, split):
    turns = make.turns(*[c[0] for c in CASES.values()])
    segments = make.segments(*[c[1] for c in CASES.values()])
    # Named, since the longest speaker need not be the teacher in such short cases.
    main = turns.select("session_id", F.lit("T").alias("main_speaker")).distinct()
    marked = iv.mark_roles(turns, main, split)
    got = {}
    for r in ds.discourse(marked, segments, split=split).collect():
        got.setdefault(r.session_id, []).append((r.answered, r.wait))
    for i, (name, (_, _, want)) in enumerate(CASES.items()):
        assert got.get(i, []) == want, name


def test_words_of_a_statement_do_not_end_the_run_of_a_question(make):
    turns = make.turns([("T", 0, 10), ("T", 10, 20), ("T", 21, 25), ("S1", 27, 31)])
    # The statement belongs to the first turn, the question to the second, and lasts until 24.
    segments = make.segments([(0, 10, "आज हम"), (10.5, 24, Q)])
    main = turns.select("session_id", F.lit("T").alias("main_speaker")).distinct()
    [row] = ds.discourse(iv.mark_roles(turns, main, False), segments, split=False).collect()
    assert (row.q_end, row.wait) == (25.0, 2.0)


@pytest.mark.parametrize("width", [0.25, 0.01, 1000.0])
def test_median_is_exact(spark, width, monkeypatch):
    monkeypatch.setattr(ds, "MEDIAN_BIN", width)
    data = [(s, i, float(v)) for s, vs in enumerate([[3, 1, 2], [4, 1, 3, 2], [5], [2, 2, 9, 9]]) for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "session_id long, turn_ix int, wait double")
    got = ds.median_by_session(df, "wait")
    assert {r.session_id: r["median"] for r in got.collect()} == {0: 2.0, 1: 2.5, 2: 5.0, 3: 5.5}
