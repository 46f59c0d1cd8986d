import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from turnlake.functions import numbers
from turnlake.operators import attribution, corpus, insight, metrics


@pytest.mark.parametrize("split", [False, True])
def test_stretch_and_switches(make, split):
    cases = [
        ([("speech", 0, 100, "teacher"), ("dead", 100, 102), ("speech", 102, 200, "teacher")], 200.0, 0),
        ([("speech", 0, 100, "teacher"), ("handson", 100, 104), ("speech", 104, 200, "teacher")], 100.0, 0),
        ([("speech", 0, 50, "teacher"), ("speech", 50, 51, "student"), ("speech", 51, 90, "teacher")], 50.0, 2),
        ([("speech", 0, 50, "teacher"), ("speech", 50, 51, None), ("speech", 51, 90, "teacher")], 50.0, 0),
        ([("dead", 0, 5)], 0.0, 0),
    ]
    got = metrics.timeline_facts(make.timeline(*[c[0] for c in cases]), split=split)
    assert {r.session_id: (r.stretch_sec, r.switches) for r in got.collect()} == {
        i: (c[1], c[2]) for i, c in enumerate(cases)}


def facts(spark, **over):
    base = dict(teacher_sec=60.0, student_sec=40.0, handson_sec=0.0, dead_sec=0.0, unattributed_sec=0.0, student_turns=4,
                switches=3, stretch_sec=60.0, mean_role_conf=0.9, audio_sec=100.0, completeness=None, mean_logprob=None)
    row = {**base, **over}
    schema = ", ".join(f"{k} {'long' if k in ('student_turns', 'switches') else 'double'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_confidence_parts_and_verdict(spark):
    full = metrics.confidence(facts(spark)).first()
    assert full.conf_asr == 0.5 and full.conf_completeness == 1.0 and full.verdict == "usable"
    assert full.confidence == pytest.approx(0.3 + 0.27 + 0.2 + 0.1)
    low = metrics.confidence(facts(spark, mean_role_conf=None, completeness=0.2, mean_logprob=-5.0, teacher_sec=1.0,
                                   student_sec=0.0)).first()
    assert (low.conf_attribution, low.conf_asr, low.verdict) == (0.0, 0.0, "unreliable")


def wide(spark, **over):
    gates = dict(split_usable=True, lexical_usable=True, has_transcript=True, split_conf=0.8, minutes=100 / 60,
                 roster_total=20, questions=5, responses=4, waits=2, median=2.0)
    gates.update({k: over.pop(k) for k in list(over) if k in gates})
    df = facts(spark, **over).withColumns({k: F.lit(v) for k, v in gates.items()}).withColumn("session_id", F.lit(1))
    return metrics.metric_rows(metrics.metric_values(df))


def test_metrics_are_withheld_rather_than_guessed(spark):
    got = {r.key[:2]: r for r in wide(spark).collect()}
    assert got["M1"].value == 0.6 and got["M1"].band == "normal"
    assert got["M5"].value is None and got["M5"].band == "unknown" and got["M5"].confidence == 0.0
    assert got["M7"].value == 5.0 and got["M8"].band == "normal"
    blind = {r.key[:2]: r.value for r in wide(spark, split_usable=False, lexical_usable=False).collect()}
    assert set(blind.values()) == {None}
    assert {r.key[:2]: r.value for r in wide(spark, waits=3).collect()}["M5"] == 2.0
    none = {r.key[:2]: r for r in wide(spark, questions=0, responses=0, waits=0).collect()}
    assert none["M7"].value == 0.0 and none["M8"].band == "unknown"


def test_rounding_is_half_even_on_the_stored_value(spark):
    values = [2.675, 0.5, 1.5, 2.5, 0.0625, 0.1875, 1.005, -2.5, -0.0625, 1e7 + 0.125, 0.285, 59.5, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3, 4):
        got = [r[0] for r in df.select(numbers.round_even(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values], digits


def test_texts(spark):
    df = spark.createDataFrame([(59.5,), (0.5,), (60.0,), (3725.9,)], "s double")
    assert [r[0] for r in df.select(numbers.duration_text(F.col("s"))).collect()] == [
        "60 seconds", "0 seconds", "1m 00s", "62m 05s"]
    long = spark.createDataFrame([("Teacher A", "h" * 390, "s"), (None, "h", "s")], "alias string, headline string, suggestion string")
    a, b = [r.message for r in insight.message(long).collect()]
    assert len(a) <= 400 and a.endswith("…") and b == "नमस्ते!\n\nh\n\n💡 s"


def test_loudness_split(spark, make):
    def session(*loud):
        return [("speech", i, i + 1) for i in range(len(loud))], loud
    cases = [session(-10.0, -12.0, -40.0, -41.0), session(-20.0), session(-15.0, -15.0), session(-10.0, -14.0)]
    tl = make.timeline(*[c[0] for c in cases]).drop("role", "role_conf", "rms_db")
    loud = spark.createDataFrame([(s, i, x) for s, c in enumerate(cases) for i, x in enumerate(c[1])],
                                 "session_id long, segment_ix int, rms_db double")
    got = attribution.roles_from_loudness(tl.join(loud, ["session_id", "segment_ix"]))
    by = {(r.session_id, r.segment_ix): (r.role, r.role_conf) for r in got.collect()}
    assert [by[0, i][0] for i in range(4)] == ["teacher", "teacher", "student", "student"]
    assert by[0, 0][1] == 1.0 and by[1, 0] == ("teacher", 0.0) and by[2, 1] == ("teacher", 0.0)
    assert by[3, 0][0] == "teacher" and by[3, 0][1] == pytest.approx(4 / 12)


@pytest.mark.parametrize("split", [False, True])
def test_aliases_go_past_z(spark, split):
    ids = spark.createDataFrame([(f"{i:04d}",) for i in range(705)] + [("0003",), (None,), ("",)], "teacher_id string")
    got = {r.teacher_id: r.alias for r in corpus.aliases(ids, split).collect()}
    assert len(got) == 705
    assert [got[f"{i:04d}"] for i in (0, 25, 26, 51, 52, 701, 702)] == [
        "Teacher " + s for s in ("A", "Z", "AA", "AZ", "BA", "ZZ", "AAA")]
    with pytest.raises(Exception, match="unknown teacher id"):
        corpus.with_alias(spark.createDataFrame([("9999",)], "teacher_id string"), corpus.aliases(ids, split)).collect()


def by_rounds(xs):
    """Forty rounds over the whole list: the centres before and after the last."""
    low, high = min(xs), max(xs)
    for _ in range(40):
        before = low, high
        near = [x for x in xs if abs(x - low) <= abs(x - high)]
        far = [x for x in xs if abs(x - low) > abs(x - high)]
        moved = lambda part, c: c if not part or abs(math.fsum(part) / len(part) - c) <= 1e-8 + 1e-5 * abs(c) else math.fsum(part) / len(part)
        low, high = moved(near, low), moved(far, high)
    return (*before, low, high)


def test_centres_against_rounds_over_lists(spark, monkeypatch):
    draw = random.Random(12)
    sessions = [[draw.choice([draw.gauss(-50, 6), draw.gauss(-20, 9), float(round(draw.gauss(-35, 10))), 0.0]) for _ in range(draw.randrange(1, 200))] for _ in range(60)]
    sessions += [[-30.0] * 5, [-30.0], [-10.0, -11.0], [float(-x) for x in range(120)], [-1e-9 * x for x in range(50)]]
    rows_ = [(s, "speech", x) for s, xs in enumerate(sessions) for x in xs] + [(0, "dead", -90.0), (3, "speech", None), (999, "speech", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r[0]: tuple(r)[1:] for r in attribution.loudness_centres(
            spark.createDataFrame(draw.sample(rows_, len(rows_)), "session_id long, kind string, rms_db double")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(range(len(sessions)))
    for s, xs in enumerate(sessions):
        assert got[s] == pytest.approx(by_rounds(xs), abs=1e-9), s


def test_centres_of_a_session_of_two_million_rows(spark):
    rows_ = spark.range(2_000_000).selectExpr("7L as session_id", "'speech' as kind", "-20 - (id * 7919 % 1000003) / 1000003 * 10 - case when id % 3 = 0 then 30 else 0 end as rms_db")
    [got] = attribution.loudness_centres(rows_).collect()
    assert got.low == pytest.approx(-55.0, abs=0.01) and got.high == pytest.approx(-25.0, abs=0.01)
