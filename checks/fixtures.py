"""The session tables, derived from the given tables by the rules in FIXTURES.md."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.plans.session_analysis import SessionAnalysis
from turnlake.scan import Ordered, needs_split, running_sum, settled

ACTIVITIES = ("Paper Theatre", "Paper Circuits", "Bridge Building", "Sound Lab")
QUESTION_LEXICON = ("is", "der", "de", "es")


def loudness(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("rms_db", F.lit(-60.0) + (F.col("session_id") * 13 + F.col("segment_ix") * 7) % 50)


class Corpus:
    """Lazily derived tables over one data folder. ``split`` is decided once, from counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._analyses: list[SessionAnalysis] = []

    def release(self) -> None:
        """Forget all tables made for this corpus, those of its analyses included."""
        for analysis in self._analyses:
            analysis.release()
        for name in [n for n in vars(self) if isinstance(getattr(type(self), n, None), cached_property)]:
            del self.__dict__[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def split(self) -> bool:
        return needs_split(self.table("conversations"), ["conv_id"])

    @cached_property
    def utterances(self) -> DataFrame:
        rows = self.table("conversations").withColumn(
            "dur", F.greatest(F.lit(0.5), F.length("text") / F.lit(16.0)))
        rows = rows.withColumn(
            "gap", ((F.col("conv_id") * 31 + F.col("turn") * 17) % 23 - 6) / F.lit(4.0))
        placed = Ordered(rows, ["conv_id"], ["turn"], self.split).with_columns(
            _before=running_sum(F.col("dur") + F.col("gap"), inclusive=False)).df
        start = F.lit(2.0) + F.coalesce("_before", F.lit(0.0))
        return placed.select(F.col("conv_id").alias("session_id"), "turn", "role", "text",
                             start.alias("start"), (start + F.col("dur")).alias("end"))

    @cached_property
    def turns(self) -> DataFrame:
        return settled(self._turns())

    def _turns(self) -> DataFrame:
        spoken = self.utterances.filter(F.col("role") != "system").withColumn(
            "speaker", F.when(F.col("role") == "assistant", "T")
            .otherwise(F.concat(F.lit("S"), (F.col("turn") % 2 + 1).cast("string"))))
        start, end = F.col("start"), F.col("end")
        parts = F.ceil((end - start) / 8.0)
        piece = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda k: F.struct(
            k.alias("k"), (start + k * 8.0).alias("a"), F.least(end, start + (k + 1) * 8.0).alias("b"),
            F.col("speaker").alias("who")))
        nested = F.when(((F.col("session_id") + F.col("turn")) % 5 == 0) & (start + 3.0 <= end), F.array(
            F.struct(F.lit(-1).cast("bigint").alias("k"), (start + 2.0).alias("a"),
                     (start + 3.0).alias("b"), F.lit("S3").alias("who")))
        ).otherwise(F.array().cast("array<struct<k:bigint,a:double,b:double,who:string>>"))
        rows = spoken.select("session_id", "turn", F.explode(F.concat(piece, nested)).alias("p")).select(
            "session_id", "turn", F.col("p.k").alias("k"), F.col("p.a").alias("start"),
            F.col("p.b").alias("end"), F.col("p.who").alias("speaker"))
        order = ["start", "speaker", "end", "turn", "k"]
        counted = Ordered(rows, ["session_id"], order, self.split).with_columns(
            turn_ix=running_sum(F.lit(1))).df
        return counted.select("session_id", F.col("turn_ix").cast("int").alias("turn_ix"),
                              "start", "end", "speaker")

    @cached_property
    def segments(self) -> DataFrame:
        rows = Ordered(self.utterances, ["session_id"], ["start", "turn"], self.split).with_columns(
            seg_ix=running_sum(F.lit(1))).df
        key = F.col("session_id") + F.col("turn")
        return rows.select(
            "session_id", F.col("seg_ix").cast("int").alias("seg_ix"), "start", "end", "text",
            F.when(key % 7 != 0, -(key % 12) / F.lit(4.0)).alias("avg_logprob"),
            F.when(key % 6 != 0, (key % 8) / F.lit(8.0)).alias("no_speech_prob"))

    @cached_property
    def transcripts(self) -> DataFrame:
        """Header rows; every thirteenth session has no transcript."""
        return self.recordings.filter(F.col("session_id") % 13 != 0).select(
            "session_id", F.lit("en").alias("language"), F.lit(None).cast("double").alias("language_prob"),
            F.lit("indic").alias("backend"), F.lit("conformer-hi").alias("model"),
            F.col("actual_sec").alias("audio_sec"))

    @cached_property
    def spoken_segments(self) -> DataFrame:
        return self.segments.filter(F.col("session_id") % 13 != 0)

    @cached_property
    def recordings(self) -> DataFrame:
        return settled(self.utterances.groupBy("session_id").agg(F.max("end").alias("actual_sec"))).select(
            "session_id", "actual_sec", F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"))

    @cached_property
    def sessions(self) -> DataFrame:
        sid = F.col("session_id")
        total = (F.lit(8) + sid % 20).cast("int")
        boys = F.floor(total / 2).cast("int")
        factor = F.when(sid % 3 == 0, 1.0).when(sid % 3 == 1, 1.5)
        return self.recordings.select(
            "session_id",
            F.when(sid % 11 != 0, F.lpad((sid % 30).cast("string"), 5, "0")).alias("teacher_id"),
            F.element_at(F.array(*[F.lit(a) for a in ACTIVITIES]), (sid % 4 + 1).cast("int")).alias("activity"),
            F.struct(total.alias("total"), boys.alias("boys"),
                     (total - boys + F.when(sid % 9 == 0, 1).otherwise(0)).alias("girls")).alias("roster"),
            (F.col("actual_sec") * factor).alias("declared_sec"),
            (F.lit("2025-12-01 09:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(days=(sid % 28).cast("int"), hours=(sid % 7).cast("int"))
             ).alias("recorded_at"),
            F.struct(F.lit("A. Name").alias("teacher_name"),
                     F.lit(None).cast("timestamp_ntz").alias("captured_at"),
                     F.when(sid % 5 >= 3, 19.0 + (sid % 8) / F.lit(8.0)).alias("latitude"),
                     F.when(sid % 5 >= 2, 73.5).alias("longitude"),
                     F.lit("somewhere").alias("address")).alias("photo"))

    @cached_property
    def analysis(self) -> SessionAnalysis:
        return self.analyse()

    def analyse(self, minutes: float | None = None, loudness_path: bool = False) -> SessionAnalysis:
        """All sessions; with ``loudness_path`` every seventeenth one has no turns."""
        turns = self.turns
        if loudness_path:
            turns = turns.filter(F.col("session_id") % 17 != 0)
        analysis = SessionAnalysis(
            sessions=self.sessions, recordings=self.recordings, turns=turns, segments=self.spoken_segments,
            transcripts=self.transcripts, measure=loudness, voice=self.turns if loudness_path else None,
            lexicon=QUESTION_LEXICON, minutes=minutes, split=self.split)
        self._analyses.append(analysis)
        return analysis
