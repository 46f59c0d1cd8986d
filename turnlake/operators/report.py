"""Published shapes: rounded rows, display tables and the result document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, METRIC_KEYS
from turnlake.functions.numbers import round_even
from turnlake.operators.intervals import numbered, text_of_spans
from turnlake.operators.metrics import completeness
from turnlake.operators.corpus import has_gps, quality_flags
from turnlake.scan import Ordered, previous

SCHEMA_VERSION = "1.0"

# How a document names the attribution and the speech detector, from turns and from loudness.
FROM_TURNS = {"attribution": "pyannote-community-1", "vad": "pyannote-community-1-segmentation"}
FROM_LOUDNESS = {"attribution": "energy-kmeans-v1", "vad": "silero@0.5"}


def published_timeline(labelled: DataFrame, segments: DataFrame | None = None,
                       split: bool | None = None) -> DataFrame:
    """Rounded timeline rows in order; role keys only where a role exists, text on speech."""
    rows = numbered(labelled, split)
    role = F.col("role").isNotNull()
    base = ["session_id", "seg_no"]
    out = rows
    if segments is not None:
        speech = rows.filter(F.col("kind") == "speech")
        out = rows.join(text_of_spans(speech, segments, ["seg_no"]), base, "left")
    else:
        out = rows.withColumn("text", F.lit(None).cast("string"))
    return out.select(
        *base, round_even(F.col("start"), 3).alias("t0"), round_even(F.col("end"), 3).alias("t1"),
        "kind", round_even(F.col("rms_db"), 2).alias("rms_db"), "role",
        F.when(role, round_even(F.coalesce("role_conf", F.lit(0.0)), 3)).alias("role_conf"),
        F.when(F.col("text") != "", F.col("text")).alias("text"))


def published_metrics(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", round_even(F.col("value"), 4)).withColumn(
        "confidence", round_even(F.col("confidence"), 3))


def published_totals(facts: DataFrame) -> DataFrame:
    """Long form of the talk-time buckets, rounded."""
    names = ("teacher", "student", "handson", "dead", "unattributed")
    return facts.select("session_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("bucket"), round_even(F.col(f"{n}_sec"), 2).alias("sec")) for n in names])))


def display_totals(totals: DataFrame) -> DataFrame:
    return totals.filter((F.col("sec") > 0) & (F.col("bucket") != "unattributed"))


def spoken_lines(timeline: DataFrame) -> DataFrame:
    return timeline.filter((F.col("kind") == "speech") & (F.coalesce("text", F.lit("")) != ""))


def withheld_metrics(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("value").isNull()).select("session_id", "key")


def shown_sessions(facts: DataFrame) -> DataFrame:
    """Sessions whose metrics may be displayed."""
    return facts.filter(F.col("verdict") != "unreliable")


def ordered_metrics(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """Seven rows per session in reading order; a missing metric becomes a withheld one."""
    keys = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("key"))
                     for i, k in enumerate(METRIC_KEYS)])
    wanted = sessions.select("session_id", F.inline(keys))
    found = wanted.join(rows.withColumn("_found", F.lit(True)), ["session_id", "key"], "left")
    return found.select(
        "session_id", "position", "key", "value", "unit", F.coalesce("band", F.lit("unknown")).alias("band"),
        "benchmark", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("_found"), F.col("formula")).otherwise("not in this file").alias("formula"))


def timeline_bars(timeline: DataFrame, recordings: DataFrame) -> DataFrame:
    """Width, class and label of each timeline row relative to the analysed seconds."""
    total = F.coalesce(F.expr("nullif(analysed_sec, 0)"), F.expr("nullif(actual_sec, 0)"), F.lit(1.0))
    speech = F.col("kind") == "speech"
    css = F.when(speech, F.coalesce("role", F.lit("unattributed"))).otherwise(F.col("kind"))
    label = (F.when(speech, F.coalesce("role", F.lit("speech, speaker unknown")))
             .when(F.col("kind") == "handson", "hands-on").otherwise("quiet"))
    rows = timeline.join(recordings.select("session_id", "analysed_sec", "actual_sec"), "session_id")
    return rows.select("session_id", "seg_no", ((F.col("t1") - F.col("t0")) / total * 100).alias("width_percent"),
                       css.alias("css_class"), label.alias("label"), "t0", "t1")


def teacher_trend(rows: DataFrame, value: str, split: bool | None = None) -> DataFrame:
    """A value over a teacher's sessions in time order, with the change from the one before."""
    trend = Ordered(rows, ["alias"], ["recorded_at", "session_id"], split).with_columns(
        _was=previous(F.col(value))).df
    return trend.withColumn("change", F.col(value) - F.col("_was")).drop("_was")


def window_bias(windowed: DataFrame, full: DataFrame) -> DataFrame:
    """Talk ratio on the analysed window against the full session."""
    return windowed.select("session_id", F.col("m1").alias("window_ratio")).join(
        full.select("session_id", F.col("m1").alias("full_ratio")), "session_id").withColumn(
        "shift", F.col("full_ratio") - F.col("window_ratio"))


def result_documents(corpus: DataFrame, values: DataFrame, metrics: DataFrame, insight: DataFrame,
                     transcripts: DataFrame, lost: DataFrame, from_turns: Mapping[str, str] = FROM_TURNS,
                     from_loudness: Mapping[str, str] = FROM_LOUDNESS) -> DataFrame:
    """The published document of each session, one row. Its timeline is a table of its own, one row
    per segment (``published_timeline``), so a document's size does not grow with its session."""
    listed = published_metrics(metrics).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "key", F.struct("value", "unit", "band", "benchmark", "confidence", "formula", "explanation",
                        "interpretation")))).alias("metrics"))
    share = completeness(F.col("actual_sec"), F.col("declared_sec"))
    names = ("teacher", "student", "handson", "dead", "unattributed")
    head = (corpus.join(values.drop("completeness", "roster_total"), "session_id").join(listed, "session_id")
            .join(insight.select("session_id", "headline", "suggestion", "summary", "metrics_shown",
                                 "generated_by", "message"), "session_id")
            .join(transcripts.select("session_id", "model", "backend"), "session_id", "left")
            .join(lost.select("session_id", "lost"), "session_id", "left"))
    flags = F.concat(quality_flags(), F.when(F.coalesce("lost", F.lit(False)), F.array(
        F.lit("attribution_lost_students"))).otherwise(F.array().cast("array<string>")))
    turns_used = F.coalesce("from_turns", F.lit(False))
    return head.select(
        "session_id", F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(F.col("teacher_id").alias("id"), "alias").alias("teacher"), "activity",
        F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("recorded_at"), "roster",
        F.struct(F.when(F.col("declared_sec") != 0, round_even(F.col("declared_sec"), 1)).alias("declared_sec"),
                 round_even(F.col("actual_sec"), 1).alias("actual_sec"),
                 round_even(F.col("audio_sec"), 1).alias("analysed_sec"),
                 round_even(share, 3).alias("completeness"), "sample_rate", "channels",
                 has_gps().alias("has_gps")).alias("audio"),
        F.struct(F.col("model").alias("asr"), F.col("backend").alias("asr_backend"),
                 *[F.when(turns_used, from_turns[k]).otherwise(from_loudness[k]).alias(k) for k in ("attribution", "vad")]).alias("models"),
        F.create_map(*[c for n in names for c in (F.lit(n), round_even(F.col(f"{n}_sec"), 2))]).alias("totals_sec"),
        "metrics",
        F.struct(round_even(F.col("confidence"), 3).alias("overall"),
                 F.struct(*[round_even(F.col(f"conf_{k}"), 3).alias(k)
                            for k in DEFAULTS.conf_weights]).alias("components"),
                 "verdict").alias("confidence"),
        F.struct("headline", "suggestion", "summary", "metrics_shown", "verdict", "generated_by",
                 F.col("message").alias("whatsapp")).alias("insight"),
        flags.alias("flags"))
