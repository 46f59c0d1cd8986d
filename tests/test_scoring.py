import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from turnlake.functions import signal
from turnlake.functions import text as tx
from turnlake.operators import labels, scoring


def edits(a, b):
    """Edit distance by its recursive definition over shrinking prefixes."""
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
    return d(len(a), len(b))


def test_word_and_character_edits(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["क्या", "é", "है", "the", "a", "ब"]) for _ in range(rng.randint(0, 9)))
    pairs = [(line(), line()) for _ in range(60)]
    df = spark.createDataFrame(pairs, "r string, h string")
    got = df.select(tx.word_edits(F.col("r"), F.col("h")), tx.char_edits(F.col("r"), F.col("h"))).collect()
    for (r, h), (w, c) in zip(pairs, got):
        assert w == edits(tuple(r.split()), tuple(h.split()))
        assert c == edits(r.replace(" ", ""), h.replace(" ", ""))


def test_edit_distance_in_blocks():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        if rng.random() < 0.3:
            b = a[:rng.randint(0, 40)] + b[:5] + a[rng.randint(0, 40):]
        expected = edits(tuple(a), tuple(b))
        for rows in (1, 3, 8, 4096):
            assert tx.edit_distance(a, b, rows) == expected
    assert tx.edit_distance("", "") == 0 and tx.edit_distance("ab", "") == 2


def test_edit_distance_of_long_texts(spark):
    rng = random.Random(3)
    ref = [f"w{rng.randint(0, 20_000)}" for _ in range(50_000)]
    hyp = list(ref)
    for i in range(0, 50_000, 500):  # words that occur nowhere else, so every one is an edit
        hyp[i] = f"x{i}"
    del hyp[-7:]
    began = time.time()
    row = spark.createDataFrame([(" ".join(ref), " ".join(hyp))], "r string, h string").select(
        tx.word_edits(F.col("r"), F.col("h")).alias("e")).first()
    assert row.e == 107 and time.time() - began < 30


def test_null_texts_have_no_words(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), ("", " ")], "r string, h string")
    got = df.select(tx.word_edits(F.col("r"), F.col("h")), tx.char_edits(F.col("r"), F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(2, 2), (0, 0), (0, 0)]


def test_normaliser(spark):
    raw = ["Namaste, Duniya!", "यह सही है।", "STRASSE Straße", "é é", "a  \t b ☃", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(tx.for_scoring(F.col("t"))).collect()]
    assert got == ["namaste duniya", "यह सही है", "strasse strasse", "é é", "a b", ""]


def test_corpus_rate_is_not_the_mean_of_rates(spark):
    samples = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "wrong"), (3, "never heard")], "sample_id int, reference string")
    outputs = spark.createDataFrame([("x", 1, "a b c d e f g h i j", 1.0), ("x", 2, "right", 1.0), ("x", 3, None, 1.0),
                                     ("y", 1, "", 2.0), ("z", 1, None, 2.0)], "backend string, sample_id int, hypothesis string, elapsed_sec double")
    got = {r.backend: r for r in scoring.rank_backends(scoring.score_backends(samples, outputs)).collect()}
    assert got["x"].wer == pytest.approx(1 / 11) and (got["x"].scored, got["x"].failed) == (2, 1)
    assert got["y"].wer == 1.0 and got["z"].wer is None and [got[k].position for k in "xyz"] == [1, 2, 3]
    with pytest.raises(Exception, match="reference is empty"):
        scoring.pair_rates(spark.createDataFrame([("।", "a")], "reference string, hypothesis string")).select("wer").collect()


def test_text_signals(spark):
    text = "one two three four five one two three four five"
    df = spark.createDataFrame([(text,), ("",), ("Subscribe TO my चैनल",)], "t string")
    t = F.col("t")
    got = df.select(tx.repetition_rate(t), tx.compression_ratio(t), tx.script_ratio(t), tx.artefact_hits(t)).collect()
    assert got[0][0] == pytest.approx(2 / 7)
    assert got[0][1] == pytest.approx(len(text) / len(gzip.compress(text.encode())))
    assert (got[1][0], got[1][1], got[1][2]) == (0.0, 0.0, 0.0)
    assert got[2][3] == ["subscribe"] and 0 < got[2][2] < 1


def test_questions(spark):
    cases = {"क्या यह": True, "यह कयामत है": False, "यह क्या": True, "really?": True, "": False, None: False, "अक्या ": False}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(tx.is_question(F.col("t"))).collect()] == list(cases.values())
    with pytest.raises(ValueError):
        tx.is_question(F.col("t"), ["two words"])


def test_composite(spark):
    base = dict(mean_logprob=0.0, speech_density=1.0, repetition_rate=0.0, script_ratio=1.0, words_per_sec=2.0, artefacts=[], chars=5)
    rows = [base, {**base, "artefacts": ["x"]}, {**base, "words_per_sec": 8.0}, {**base, "words_per_sec": 80.0},
            {**base, "mean_logprob": None}, {**base, "chars": 0}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "mean_logprob double, speech_density double, repetition_rate double, "
                               "script_ratio double, words_per_sec double, artefacts array<string>, chars int")
    assert [r[0] for r in df.select(scoring.composite()).collect()] == pytest.approx([1.0, 0.5, 0.5, 0.2, 0.8, 0.0])


def test_unlabelled_rows_never_count_as_right(spark):
    df = spark.createDataFrame([("s", "teacher", "teacher", 0.9), ("s", "student", None, 0.9), ("s", "student", "teacher", 0.1)],
                               "sheet string, predicted string, truth string, confidence double")
    r = labels.score_labels(df).first()
    assert (r.total, r.labelled, r.correct, r.accuracy, r.confident_accuracy) == (3, 2, 1, 0.5, 1.0)
    assert (r.recall_teacher, r.recall_student) == (0.5, None)
    assert labels.score_by_sheet(df).filter("is_total").first().accuracy == 0.5


def test_flatness_separates_noise_from_tone(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    tone = np.sin(np.arange(256) * 2 * np.pi * 16 / 256)
    waves = [(0, tone.tolist()), (1, rng.standard_normal(256).tolist()), (2, [0.0] * 64), (3, [1.0] * 8)]
    df = spark.createDataFrame(waves, "id int, w array<double>")
    got = {r.id: r.flatness for r in signal.spectral_flatness(df, "id", "w").collect()}
    assert got[0] < 0.01 < 0.3 < got[1] and got[2] == 0.0 and got[3] == 0.0
    loud = {r.id: r.db for r in df.select("id", signal.rms_db(F.col("w")).alias("db")).collect()}
    assert loud[3] == 0.0 and loud[2] == pytest.approx(-240.0)


def test_samples_a_backend_lacks_have_failed(spark):
    samples = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e f")], "sample_id long, reference string")
    outputs = spark.createDataFrame([(1, "x", "a b", 1.0), (2, "x", None, 1.0), (1, "y", "a", 2.0), (2, "y", "c d", 2.0), (3, "y", "", 2.0)],
                                    "sample_id long, backend string, hypothesis string, elapsed_sec double")
    got = {r.backend: (r.scored, r.failed, r.wer) for r in scoring.score_backends(samples, outputs).collect()}
    assert got == {"x": (1, 2, 0.0), "y": (3, 0, 0.5)}


def test_backend_without_rows_has_failed_everywhere(spark):
    samples = spark.createDataFrame([(1, "a b"), (2, "c d")], "sample_id long, reference string")
    outputs = spark.createDataFrame([(1, "x", "a b", 1.0), (1, "other", "a", 2.0)], "sample_id long, backend string, hypothesis string, elapsed_sec double")
    got = {r.backend: (r.scored, r.failed, r.wer, r.cer) for r in scoring.score_backends(samples, outputs, ["x", "mute", "x"]).collect()}
    assert got == {"x": (1, 1, 0.0, 0.0), "mute": (0, 2, None, None)}
    none = scoring.score_backends(samples, outputs.limit(0), ["mute"]).collect()
    assert [(r.backend, r.scored, r.failed, r.wer) for r in none] == [("mute", 0, 2, None)]
    with pytest.raises(ValueError):
        scoring.score_backends(samples, outputs, [])


def test_agreement_ignores_doubled_rows(spark):
    rows = [(1, "x", "a b c"), (1, "y", "b c d"), (1, "z", ""), (2, "x", "a"), (3, "x", None), (3, "y", "")]
    df = spark.createDataFrame(rows, "clip_id long, label string, text string")
    expected = {(1, "x"): 0.25, (1, "y"): 0.25, (1, "z"): 0.0, (2, "x"): None, (3, "x"): 0.0, (3, "y"): 0.0}
    for given in (df, df.union(df.filter("label = 'x'")), df.union(df)):
        got = scoring.agreement(given).collect()
        assert len(got) == given.count()
        assert {(r.clip_id, r.label): r.agreement for r in got} == expected


def test_sheet_named_null_is_not_the_total(spark):
    from turnlake.operators import labels
    df = spark.createDataFrame([(None, "teacher", "teacher", 0.9), ("s", "teacher", "student", 0.9)],
                               "sheet string, predicted string, truth string, confidence double")
    got = labels.score_by_sheet(df)
    assert sorted((str(r.sheet), r.is_total) for r in got.collect()) == [("None", False), ("None", True), ("s", False)]


def test_separators_are_white_space(spark):
    from pyspark.sql import functions as F
    from turnlake.functions import text as tx
    df = spark.createDataFrame([("\x1c a\x1db \x1f",)], "t string")
    row = df.select(tx.strip(F.col("t")).alias("s"), tx.words(F.col("t")).alias("w")).first()
    assert row.s == "a\x1db" and row.w == "\x1c a\x1db \x1f".split()


def test_repeated_text_is_packed_as_if_it_stood_whole(spark):
    """The gzip size of a text said many times, of which only one goes to the worker."""
    import gzip
    for text in ("ab", "Grüße, " * 30, "".join(chr(97 + i * i % 23) for i in range(2000)), "x" * 70_000):
        for times in (1, 2, 33, 200):
            assert tx.gzip_size(text.encode(), times) == len(gzip.compress((text * times).encode()))
    df = spark.createDataFrame([(1, "la lé "), (2, ""), (3, None)], "id int, text string")
    got = [r[1] for r in df.select("id", tx.compression_ratio(F.col("text"), 200).alias("ratio")).orderBy("id").collect()]
    whole = ("la lé " * 200).encode()
    assert got == [len(whole) / len(gzip.compress(whole)), 0.0, 0.0]
