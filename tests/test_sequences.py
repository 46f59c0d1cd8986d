import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from turnlake.operators import sequences as sq


def test_chunks_cover_the_recording(spark):
    rec = spark.createDataFrame([(0, 200.0), (1, 90.0), (2, 183.0), (3, 10.0)], "session_id long, actual_sec double")
    got = rows(sq.plan_chunks(rec, 90.0, 2.0), "session_id", "chunk_ix", "start", "duration")
    assert got == [(0, 0, 0.0, 90.0), (0, 1, 88.0, 92.0), (0, 2, 178.0, 22.0), (1, 0, 0.0, 90.0),
                   (2, 0, 0.0, 90.0), (2, 1, 88.0, 95.0), (3, 0, 0.0, 10.0)]
    with pytest.raises(ValueError):
        sq.plan_chunks(rec, 90.0, 90.0)


def test_clips_do_not_overlap_and_shrink_to_what_fits(spark):
    rec = spark.createDataFrame([(0, 1000.0), (1, 20.0), (2, 70.0)], "session_id long, actual_sec double")
    got = sq.select_clips(rec, 3, 30.0).orderBy("session_id", "clip_ix").collect()
    assert [(r.session_id, r.clip_id, r.start, r.duration) for r in got] == [
        (0, "0_c00", 252.5, 30.0), (0, "0_c01", 485.0, 30.0), (0, "0_c02", 717.5, 30.0), (1, "1_c00", 0.0, 20.0),
        (2, "2_c00", 4.5, 30.0), (2, "2_c01", 35.5, 30.0)]


def test_missing_part_stops_the_job(spark):
    chunks = sq.plan_chunks(spark.createDataFrame([(0, 200.0)], "session_id long, actual_sec double"), 90.0, 2.0)
    parts = chunks.filter("chunk_ix < 2").select("session_id", "chunk_ix")
    segs = spark.createDataFrame([(0, 0, 1, 1.0, 2.0, "a")], "session_id long, chunk_ix int, seg_ix int, start double, end double, text string")
    with pytest.raises(Exception, match="parts and chunks differ in session 0"):
        sq.place_parts(parts, segs, chunks).collect()
    assert rows(sq.chunk_counts(parts, chunks), "session_id", "planned", "got") == [(0, 3, 2)]


@pytest.mark.parametrize("split", [False, True])
def test_repeats_are_judged_against_the_last_kept_segment(spark, split):
    rng = random.Random(5)
    data, t = [], 0.0
    for i in range(300):
        t += rng.choice([-0.5, 0.4, 0.7, 1.0, 3.0])
        data.append((0, i // 50, i, t, t + 1, rng.choice("aaab")))
    df = spark.createDataFrame(data, "session_id long, chunk_ix int, seg_ix int, start double, end double, text string")
    kept = []
    for r in data:
        if not (kept and kept[-1][5] == r[5] and abs(kept[-1][3] - r[3]) <= 1.0):
            kept.append(r)
    got = sq.drop_repeats(df, split).orderBy("seg_ix").collect()
    assert [r.seg_ix for r in got] == [r[2] for r in kept] and len(kept) < 300


def test_token_runs(spark):
    data = [(" आ", 0.0, -0.1), ("ज", 0.2, None), (" हम", 0.5, -0.3), (" ठीक", 3.0, None), ("  ", 9.0, -1.0), (" x", 20.0, -2.0)]
    df = spark.createDataFrame([(0, i, tok, at, lp, 20.01) for i, (tok, at, lp) in enumerate(data)],
                               "session_id long, token_ix int, token string, at double, logprob double, audio_sec double")
    got = sq.segments_from_tokens(df, 1.0, False).orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(0.0, 0.7, "आज हम"), (3.0, 3.2, "ठीक"), (20.0, 20.01, "x")]
    assert got[0].avg_logprob == pytest.approx(-0.2) and got[1].avg_logprob is None


def test_sweep_bridges_then_drops(spark):
    scores = [0, 1, 1, 0, 1, 0, 0, 0, 1, 0]
    frames = spark.createDataFrame([("c", i, float(s)) for i, s in enumerate(scores)], "clip_id string, frame_ix int, score double")
    got = sq.sweep_settings(frames, [("a", 0.5, 2, 2), ("b", 0.5, 1, 1), ("none", 2.0, 1, 1)], False)
    assert {(r.setting, r.coverage) for r in got.collect()} == {("a", 40.0), ("b", 40.0), ("none", 0.0)}


def test_shift_moves_words_and_empties_become_null(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, [(1.0, 1.5, "a")]), (0, 3.0, 4.0, [])],
                               "session_id long, start double, end double, words array<struct<start:double,end:double,word:string>>")
    a, b = sq.shift(df, F.lit(10.0)).collect()
    assert (a.start, a.words[0].start, b.words) == (11.0, 11.0, None)


def test_chunks_become_one_transcript(spark, make):
    from turnlake.plans.stitching import stitch
    recordings = spark.createDataFrame([(0, 150.0), (1, 20.0)], "session_id long, actual_sec double")
    chunks = sq.plan_chunks(recordings, 90.0, 2.0)
    parts = spark.createDataFrame([(0, 0, "hi", 0.4, "b0", "m"), (0, 1, "mr", 0.9, "b1", "m"), (1, 0, "en", None, "b2", "m")],
                                  "session_id long, chunk_ix int, language string, language_prob double, backend string, model string")
    heard = spark.createDataFrame([(0, 0, 1, 5.0, 6.0, "one"), (0, 0, 2, 89.0, 89.9, "two"), (0, 1, 1, 1.2, 2.0, "two"), (0, 1, 2, 30.0, 31.0, "two")],
                                  "session_id long, chunk_ix int, seg_ix int, start double, end double, text string")
    heads, segments = stitch(parts, heard, chunks, recordings)
    assert rows(heads, "session_id", "language", "backend", "audio_sec") == [(0, "mr", "b0", 150.0), (1, "en", "b2", 20.0)]
    assert rows(segments, "seg_ix", "text", "start") == [(1, "one", 5.0), (2, "two", 89.0), (3, "two", 118.0)]
