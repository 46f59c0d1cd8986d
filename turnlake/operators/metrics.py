"""The engagement metrics, their confidence, and the rules that withhold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, METRIC_KEYS, Thresholds
from turnlake.functions.numbers import band, clamp, percent_text, whole_text
from turnlake.scan import Ordered, last_value

SESSION = ["session_id"]

# Units, formulas and benchmarks of the seven metrics, in reading order.
UNITS = ("ratio", "turns/child/hour", "switches/min", "sec", "sec", "questions", "responses")
FORMULAS = (
    "teacher_speech_sec / (teacher_speech_sec + student_speech_sec)",
    "(student_turns / roster_total) / lesson_minutes * 60",
    "speaker_switches(teacher <-> student) / lesson_minutes",
    "max(continuous teacher speech, merging pauses under 3s)",
    "median(start_of_next_student_turn - end_of_teacher_question)",
    "count(teacher turns whose transcript reads as a question)",
    "count(questions answered by a student within 15s)",
)
BENCHMARKS = (0.40, None, None, None, 3.0, None, None)

# Our own short descriptions.
EXPLANATIONS = (
    "Teacher's share of spoken time; non-speech is left out.",
    "Student turns per child and hour, by the recorded headcount.",
    "How often the floor passes between teacher and students.",
    "The longest the teacher talked without a real break.",
    "The pause between a teacher's question and the next student.",
    "Questions the teacher asked, answered or not.",
    "Questions a student took up in time.",
)


def is_speech() -> Column:
    return F.col("kind") == "speech"


def attributed() -> Column:
    return is_speech() & F.col("role").isNotNull()


def timeline_facts(labelled: DataFrame, role: str = "teacher", split: bool | None = None,
                   t: Thresholds = DEFAULTS) -> DataFrame:
    """Everything the acoustic metrics need, in one pass over the ordered timeline.

    Floor switches compare a row with the attributed row before it. A stretch goes on over
    pauses up to the merge gap; any other speech ends it, which the marker row with an empty
    end stands for.
    """
    mine = is_speech() & (F.coalesce("role", F.lit("")) == role)
    marker = F.when(mine, F.struct(F.col("end").alias("e"))).when(
        is_speech(), F.struct(F.lit(None).cast("double").alias("e")))
    rows = Ordered(labelled, SESSION, ["start"], split).with_columns(
        _spoke=last_value(F.when(attributed(), F.col("role"))), _mark=last_value(marker))
    opens = F.col("_mark.e").isNull() | (F.col("start") - F.col("_mark.e") > t.stretch_merge_gap_sec)
    rows = rows.map(lambda df: df.withColumn("_opens", F.when(mine & opens, F.col("start"))))
    rows = rows.with_columns(_since=last_value(F.col("_opens"), inclusive=True))
    sec = F.col("end") - F.col("start")

    def seconds(cond: Column) -> Column:
        return F.sum(F.when(cond, sec).otherwise(0.0))

    said = F.coalesce("role", F.lit("none"))
    return rows.df.groupBy("session_id").agg(
        seconds(is_speech() & (said == "teacher")).alias("teacher_sec"),
        seconds(is_speech() & (said == "student")).alias("student_sec"),
        seconds(F.col("kind") == "handson").alias("handson_sec"),
        seconds(F.col("kind") == "dead").alias("dead_sec"),
        seconds(is_speech() & F.col("role").isNull()).alias("unattributed_sec"),
        F.count_if(is_speech() & (said == "student")).alias("student_turns"),
        F.count_if(attributed() & (F.col("_spoke") != F.col("role"))).alias("switches"),
        F.coalesce(F.max(F.when(mine, F.col("end") - F.col("_since"))), F.lit(0.0)).alias("stretch_sec"),
        F.avg(F.when(attributed(), F.col("role_conf"))).alias("mean_role_conf"))


def completeness(actual: Column, declared: Column) -> Column:
    """Measured over declared length; null when nothing was declared."""
    return F.when(declared != 0, actual / declared)


def transcript_stats(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Speech seconds, density and duration-weighted mean log-probability per transcript."""
    sec = F.col("end") - F.col("start")
    scored = F.col("avg_logprob").isNotNull() & (sec > 0)
    sums = segments.groupBy("session_id").agg(
        F.sum(sec).alias("speech_sec"),
        F.sum(F.when(scored, F.col("avg_logprob") * sec)).alias("_lp"),
        F.sum(F.when(scored, sec)).alias("_lp_sec"),
        F.avg("no_speech_prob").alias("mean_no_speech"),
        F.count(F.lit(1)).alias("segments"))
    joined = transcripts.join(sums, "session_id", "left")
    speech = F.coalesce("speech_sec", F.lit(0.0))
    return joined.select(
        "session_id", speech.alias("speech_sec"),
        F.least(F.lit(1.0), speech / F.col("audio_sec")).alias("speech_density"),
        (F.col("_lp") / F.col("_lp_sec")).alias("mean_logprob"), "mean_no_speech",
        F.coalesce("segments", F.lit(0)).alias("segments"))


def transcript_text(segments: DataFrame) -> DataFrame:
    """Whole text per transcript, segments in order."""
    listed = segments.filter(F.col("text") != "").groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "seg_ix", "text"))).alias("xs"))
    return listed.select("session_id",
                         F.array_join(F.transform("xs", lambda x: x["text"]), " ").alias("text"))


def confidence(facts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Overall confidence and its parts from timeline facts, audio and transcript columns."""
    spoken = F.col("teacher_sec") + F.col("student_sec")
    density = F.when(F.col("audio_sec") > 0, F.least(F.lit(1.0), spoken / F.col("audio_sec"))).otherwise(0.0)
    parts = {
        "speech_density": F.least(F.lit(1.0), density / 0.5),
        "attribution": F.coalesce("mean_role_conf", F.lit(0.0)),
        "completeness": F.coalesce(clamp(F.col("completeness")), F.lit(1.0)),
        "asr": F.when(F.col("mean_logprob").isNull(), 0.5).otherwise(
            clamp((F.col("mean_logprob") + 3.0) / 3.0)),
    }
    out = facts.withColumns({f"conf_{k}": v for k, v in parts.items()})
    total = F.lit(0.0)
    for k, weight in t.conf_weights.items():
        total = total + F.lit(weight) * F.col(f"conf_{k}")
    return out.withColumn("confidence", clamp(total)).withColumn("verdict", verdict(F.col("confidence"), t))


def verdict(conf: Column, t: Thresholds = DEFAULTS) -> Column:
    return (F.when(conf >= t.conf_usable, "usable")
            .when(conf >= t.conf_unreliable, "partial").otherwise("unreliable"))


def session_facts(labelled: DataFrame, sessions: DataFrame, recordings: DataFrame,
                  stats: DataFrame, totals: DataFrame | None, split: bool | None = None,
                  t: Thresholds = DEFAULTS) -> DataFrame:
    """One wide row per session: timeline facts, confidence, gates and, if ``totals`` are given, discourse counts.

    ``recordings`` holds the analysed seconds as ``actual_sec``; completeness always compares
    the full file, given by ``sessions.measured_sec``, with the declared length.
    """
    facts = timeline_facts(labelled, "teacher", split, t)
    meta = sessions.select(
        "session_id", F.col("roster.total").alias("roster_total"),
        completeness(F.col("measured_sec"), F.col("declared_sec")).alias("completeness"))
    wide = (recordings.select("session_id", F.col("actual_sec").alias("audio_sec"))
            .join(meta, "session_id").join(facts, "session_id")
            .join(stats.select("session_id", "mean_logprob", F.lit(True).alias("has_transcript")),
                  "session_id", "left"))
    if totals is not None:
        wide = wide.join(totals, "session_id", "left")
    wide = confidence(wide.fillna(False, ["has_transcript"]), t)
    usable = F.col("conf_attribution") >= t.role_conf_floor
    return (wide.withColumn("split_usable", usable)
            .withColumn("split_conf", F.least("confidence", "conf_attribution"))
            .withColumn("lexical_usable", F.col("has_transcript") & usable
                        & (F.col("verdict") != "unreliable"))
            .withColumn("minutes", F.col("audio_sec") / 60.0))


def acoustic_values(facts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The four values that rest on the timeline, as columns; null means withheld."""
    usable, minutes = F.col("split_usable"), F.col("minutes")
    spoken = F.col("teacher_sec") + F.col("student_sec")
    return facts.withColumns({
        "m1": F.when(usable & (spoken > 0), F.col("teacher_sec") / spoken),
        "m2": F.when(usable & (F.col("roster_total") > 0) & (minutes > 0),
                     F.col("student_turns") / F.col("roster_total") / minutes * 60.0),
        "m3": F.when(usable & (minutes > 0), F.col("switches") / minutes),
        "m4": F.when(usable, F.col("stretch_sec")),
    })


def metric_values(facts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The seven values per session as columns; null means withheld. ``facts`` has the discourse counts too."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    enough = F.col("lexical_usable") & (count("waits") >= t.wait_min_samples)
    return acoustic_values(facts, t).withColumns({
        "m5": F.when(enough, F.col("median")),
        "m7": F.when(F.col("lexical_usable"), count("questions")),
        "m8": F.when(F.col("lexical_usable"), count("responses")),
        "wait_count": F.when(F.col("lexical_usable"), count("waits")).otherwise(0),
    })


def metric_rows(values: DataFrame, t: Thresholds = DEFAULTS, keys: Sequence[str] = METRIC_KEYS) -> DataFrame:
    """Long form: one row per session and metric. The acoustic ones need ``acoustic_values`` only."""
    m = {i: F.col(f"m{i}").cast("double") for i in (1, 2, 3, 4, 5, 7, 8)}
    lexical_conf = F.col("split_conf") * F.when(F.col("has_transcript"), t.transcript_discount).otherwise(0.0)
    samples = F.when(F.col("m5").isNotNull(), F.least(
        F.lit(1.0), F.col("wait_count") / F.lit(2.0 * t.wait_min_samples))).otherwise(0.0)
    rate = F.when(F.col("minutes") > 0, m[7] / F.col("minutes") * 60.0)
    share = F.when(m[7] > 0, m[8] / m[7])
    bands = (band(m[1], t.talk_benchmark, t.talk_high), band(m[2], 1.0, 6.0), band(m[3], 0.5, 4.0),
             band(m[4], 60.0, 300.0), band(m[5], t.wait_low_sec, 8.0), band(rate, 30.0, 120.0),
             band(share, 0.4, 0.8))
    confs = [F.col("split_conf")] * 4 + [lexical_conf * samples, lexical_conf, lexical_conf]
    withheld = F.lit("Withheld: the teacher/student split is not separable here.")
    no_text = F.lit("Withheld: needs a transcript and a separable speaker split.")
    notes = [F.when(m[i].isNull(), withheld).otherwise("Rests on the speaker split.") for i in (1, 2, 3, 4)]
    notes.append(F.when(m[5].isNotNull(), F.format_string("Median of %d pauses.", F.col("wait_count")))
                 .otherwise(F.format_string("Withheld: %d pauses found, %d needed.", F.col("wait_count"),
                                            F.lit(t.wait_min_samples))))
    notes.append(F.when(rate.isNull(), no_text).otherwise(F.concat(whole_text(rate), F.lit(" per hour."))))
    notes.append(F.when(share.isNotNull(), F.concat(
        m[8].cast("int").cast("string"), F.lit(" of "), m[7].cast("int").cast("string"),
        F.lit(" answered ("), percent_text(share), F.lit(").")))
        .when(m[7] == 0, F.lit("No question was found.")).otherwise(no_text))
    rows = [F.struct(
        F.lit(METRIC_KEYS[i]).alias("key"), m[n].alias("value"), F.lit(UNITS[i]).alias("unit"),
        bands[i].alias("band"), F.lit(BENCHMARKS[i]).cast("double").alias("benchmark"),
        confs[i].alias("confidence"), F.lit(FORMULAS[i]).alias("formula"),
        F.lit(EXPLANATIONS[i]).alias("explanation"), notes[i].alias("interpretation"))
        for i, n in enumerate((1, 2, 3, 4, 5, 7, 8)) if METRIC_KEYS[i] in keys]
    return values.select("session_id", F.inline(F.array(*rows)))


def lost_students(marked: DataFrame, labelled: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Sessions where turns hold other voices but the timeline has no student time."""
    def student_sec(name: str) -> Column:
        return F.sum(F.when(F.col("role") == "student", F.col("end") - F.col("start")).otherwise(0.0)).alias(name)

    rows = marked.groupBy("session_id").agg(student_sec("other_sec")).join(
        labelled.groupBy("session_id").agg(student_sec("student_sec")), "session_id", "left")
    return rows.withColumn("lost", (F.col("other_sec") >= t.min_other_speaker_sec)
                           & (F.coalesce("student_sec", F.lit(0.0)) <= 0))


def speech_profile(timeline: DataFrame, recordings: DataFrame) -> DataFrame:
    """Speech share, spans per minute, median span, and mean loudness per session.

    Loudness is averaged as amplitude over the timeline rows and turned back into dB.
    """
    from turnlake.operators.discourse import median_by_session
    sec = F.col("end") - F.col("start")
    sums = timeline.groupBy("session_id").agg(
        F.sum(F.when(is_speech(), sec)).alias("speech"), F.count_if(is_speech()).alias("n"),
        F.avg(F.pow(F.lit(10.0), F.col("rms_db") / 20.0)).alias("level"))
    spans = timeline.filter(is_speech()).withColumn("sec", sec)
    return (recordings.select("session_id", "actual_sec").join(sums, "session_id")
            .join(median_by_session(spans, "sec"), "session_id", "left")
            .select("session_id", (100.0 * F.coalesce("speech", F.lit(0.0)) / F.col("actual_sec")).alias("speech_percent"),
                    (60.0 * F.col("n") / F.col("actual_sec")).alias("spans_per_minute"),
                    F.coalesce("median", F.lit(0.0)).alias("median_span"), (20.0 * F.log10("level")).alias("loudness_db")))
