import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from turnlake.operators import intervals as iv


def labelled(make, timeline, turns, split=False):
    t = make.turns(turns)
    tl = make.timeline(timeline).drop("role", "role_conf")
    return iv.split_by_speaker(tl, t, iv.main_speaker(t), split)


def test_union_merges_overlapping_and_touching_spans(make):
    t = make.turns([("A", 0, 5), ("B", 5, 6), ("A", 2, 3), ("B", 8, 8), ("A", 9, 7), ("A", 10, 12)])
    assert rows(iv.union_spans(t, False), "start", "end") == [(0.0, 6.0), (10.0, 12.0)]


@pytest.mark.parametrize("split", [False, True])
def test_tiles_cover_every_second_once(spark, make, split):
    rec = spark.createDataFrame([(0, 20.0), (1, 5.0)], "session_id long, actual_sec double")
    t = make.turns([("A", -1, 4), ("B", 3, 6), ("A", 10, 99)])
    tiles = iv.tile(iv.clip_and_union(t, rec, split), rec, split)
    assert rows(tiles, "session_id", "segment_ix", "start", "end", "is_speech") == [
        (0, 0, 0.0, 6.0, True), (0, 1, 6.0, 10.0, False), (0, 2, 10.0, 20.0, True), (1, 0, 0.0, 5.0, False)]


def test_winner_prefers_the_enclosed_turn_on_a_tie(spark, make):
    t = make.turns([("T", 0, 20), ("S1", 5, 6)])
    spans = spark.createDataFrame([(0, 1, 5.0, 6.0), (0, 2, 0.0, 20.0), (0, 3, 5.5, 15.0), (0, 4, 30.0, 31.0)],
                                  "session_id long, n int, start double, end double")
    assert rows(iv.speaker_for_spans(spans, t, ["n"]), "n", "speaker") == [(1, "S1"), (2, "T"), (3, "T")]


def winner_by_definition(turns, start, end, tol=1e-6):
    """The end of the chain in which each leader is followed by the first later turn that beats it."""
    shares = [(min(end, b) - max(start, a), b - a, who) for who, a, b in turns]
    runners = [(o, o / whole if whole > 0 else 1.0, who) for o, whole, who in shares if o > 0]

    def chain(led, others):
        ahead = [i for i, r in enumerate(others) if r[0] - led[0] > tol or (abs(r[0] - led[0]) <= tol and r[1] > led[1])]
        return chain(others[ahead[0]], others[ahead[0] + 1:]) if ahead else led[2]
    return chain((0.0, 0.0, None), runners)


def test_winner_follows_the_tolerance_walk(spark, make):
    rng = random.Random(11)
    turns = [(f"S{i}", a := rng.randint(0, 12), a + rng.choice([1, 2, 4]) + rng.randint(0, 6) * 4e-7) for i in range(120)]
    spans = [(0, n, float(a), a + 3.0) for n, a in enumerate(range(0, 14))]
    got = iv.speaker_for_spans(spark.createDataFrame(spans, "session_id long, n int, start double, end double"),
                               make.turns(turns), ["n"])
    want = {n: winner_by_definition(turns, a, b) for _, n, a, b in spans}
    assert {r.n: r.speaker for r in got.collect()} == {n: w for n, w in want.items() if w}


def test_main_speaker_margin_and_ties(make):
    t = make.turns([("A", 0, 6), ("B", 6, 8)], [("X", 0, 3), ("Y", 3, 6)], [("Z", 0, 1)])
    assert rows(iv.main_speaker(t), "session_id", "main_speaker", "margin") == [
        (0, "A", 0.5), (1, "X", 0.0), (2, "Z", 1.0)]


@pytest.mark.parametrize("split", [False, True])
def test_nested_student_turns_keep_their_time(make, split):
    out = labelled(make, [("speech", 0, 60)], [("T", 0, 60), ("S1", 10, 12), ("S2", 25, 27.5), ("S1", 40, 43)], split)
    sums = {r.role: r.sec for r in out.groupBy("role").agg(F.sum(F.col("end") - F.col("start")).alias("sec")).collect()}
    assert sums == {"student": 7.5, "teacher": 52.5}


@pytest.mark.parametrize("split", [False, True])
def test_cuts_at_turn_edges_form_no_pairs(spark, make, split):
    draw = random.Random(5)
    marks = [sorted({0.0, *(draw.randrange(1, 400) / 4 for _ in range(12))}) for _ in range(6)]
    tiles = [[(draw.choice(["speech", "speech", "dead"]), a, b) for a, b in zip(m, m[1:])] for m in marks]
    turns = [[("A", a, a + draw.randrange(0, 60) / 5) for a in (draw.randrange(0, 500) / 5 for _ in range(n))] for n in (60, 40, 9, 2, 1, 0)]
    turns[0] += [("B", a, b) for _, a, b in turns[0]] + [("C", a, b) for _, a, b in tiles[0]]
    wanted = []
    for s, segs in enumerate(tiles):
        edges = {e for _, a, b in turns[s] for e in (a, b)}
        for i, (kind, a, b) in enumerate(segs):
            points = [a, *sorted(e for e in edges if a < e < b), b]
            wanted += [(s, i, x, y) for x, y in zip(points, points[1:]) if kind == "speech" and y - x >= 0.30]
    got = iv.cut_at_turn_edges(make.timeline(*tiles), make.turns(*turns), split)
    assert sorted(tuple(r) for r in got.select("session_id", "segment_ix", "start", "end").collect()) == sorted(wanted)
    assert split or ("Join" not in (plan := got._jdf.queryExecution().sparkPlan().toString()) and "Aggregate" not in plan)


def test_slivers_vanish_and_the_segment_still_tiles(make):
    # The student holds most time, so the teacher here; the hole from 4 to 4.2 is too short to be a piece.
    out = labelled(make, [("dead", 0, 1), ("speech", 1, 10)], [("B", 1, 4), ("A", 4.2, 10)])
    assert rows(out, "start", "end", "role") == [(0.0, 1.0, None), (1.0, 4.2, "student"), (4.2, 10.0, "teacher")]


def test_short_unattributed_piece_joins_what_precedes_it(spark, make):
    pieces = spark.createDataFrame([
        (0, 0, 0.0, 0.5, None), (0, 0, 0.5, 3.0, "teacher"), (0, 0, 3.0, 4.0, None), (0, 0, 4.0, 6.0, "teacher"),
        (0, 0, 6.0, 7.5, None), (0, 0, 7.5, 8.0, None), (0, 0, 8.0, 9.0, "student")],
        "session_id long, segment_ix int, start double, end double, role string")
    assert rows(iv.merge_adjacent(pieces, False), "start", "end", "role") == [
        (0.0, 0.5, None), (0.5, 6.0, "teacher"), (6.0, 8.0, None), (8.0, 9.0, "student")]


def test_speech_nobody_covers_stays_unattributed(make):
    out = labelled(make, [("speech", 0, 4), ("speech", 4, 9)], [("T", 4, 9)])
    assert rows(out, "start", "end", "role", "role_conf") == [(0.0, 4.0, None, None), (4.0, 9.0, "teacher", 0.5)]


def test_tiles_measured_from_frames(spark):
    import math
    tiles = spark.createDataFrame([(0, 0, 0.0, 100.0), (0, 1, 100.0, 101.0), (1, 0, 0.0, 5.0)],
                                  "session_id long, segment_ix int, start double, end double")
    frames = spark.createDataFrame([(0, 0.0, 4, 1.0, 2, 2.0, 0.0), (0, 70.0, 4, 3.0, 2, 6.0, 2 * math.log(3.0)), (0, 100.0, 4, 0.0, 2, 0.0, -50.0)],
                                   "session_id long, at double, samples int, energy double, bins int, power double, log_power double")
    got = {(r.session_id, r.segment_ix): (round(r.rms_db, 6), round(r.flatness, 6)) for r in iv.measured(tiles, frames).collect()}
    assert got == {(0, 0): (round(20 * math.log10(math.sqrt(0.5)), 6), round(math.sqrt(3.0) / 2.0, 6)), (0, 1): (-240.0, 0.0), (1, 0): (-120.0, 0.0)}


def test_tiles_measured_from_samples(spark):
    import numpy as np

    from turnlake.functions.signal import FLOOR
    rng = np.random.default_rng(5)
    wave = (rng.standard_normal(5000) * 0.1 + np.sin(np.arange(5000) / 3)).astype("float32")
    wave[1000:1200] = 0.0
    cuts = [0, 700, 701, 1500, 4096, 5000]
    blocks = [(0, a, wave[a:b].tolist()) for a, b in zip(cuts, cuts[1:])] + [(0, 9000, []), (2, 0, None), (3, 0, [None, 0.5])]
    waves = spark.createDataFrame(blocks, "session_id long, first long, samples array<float>")
    # A long tile, a silent one, one of 9 samples, one past the recording, one between samples, one of another session.
    spans = [(0, 0, 0.0, 38.07), (0, 1, 100.0, 120.0), (0, 2, 12.34, 13.25), (0, 3, 490.0, 505.0), (0, 4, 600.0, 700.0),
             (0, 5, 3.01, 3.09), (1, 0, 0.0, 5.0), (2, 0, 0.0, 1.0), (3, 0, 0.0, 1.0)]
    tiles = spark.createDataFrame(spans, "session_id long, segment_ix int, start double, end double")
    got = {(r.session_id, r.segment_ix): (r.rms_db, r.flatness) for r in iv.measured_samples(tiles, waves, 10).collect()}
    assert len(got) == len(spans)
    for sid, ix, start, end in spans:
        own = {0: wave, 3: np.array([0.0, 0.5])}.get(sid, np.zeros(0))[int(start * 10):int(end * 10)].astype("float64")
        db, flat = -120.0, 0.0
        if len(own):
            db = 20 * np.log10(max(np.sqrt(np.mean(own ** 2)), FLOOR))
        if len(own) >= 32:
            power = np.maximum((np.abs(np.fft.rfft(own * np.hanning(len(own)))) ** 2)[1:], FLOOR)
            flat = 0.0 if not own.any() else np.exp(np.log(power).mean()) / power.mean()
        assert got[sid, ix] == (pytest.approx(db), pytest.approx(flat))
    assert [r.rms_db for r in iv.measured_samples(tiles, waves.limit(0), 10).collect()] == [-120.0] * len(spans)
