"""Session analysis: turns, transcript and loudness in, published documents out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.config import ACOUSTIC_KEYS, DEFAULTS, QUESTION_WORDS, Thresholds
from turnlake.operators import attribution, corpus, discourse, insight, intervals, metrics, report
from turnlake.scan import needs_split, settled


@dataclass
class SessionAnalysis:
    """All sessions at once. Each table is declared once and built on first use.

    Tables several branches read (turns with roles, the labelled timeline, the values) are written to the
    shared folder when they are first asked for, and read from there.

    ``measure`` adds ``rms_db`` to the tiles, usually ``intervals.measured`` over a table
    of measurements. ``voice`` gives speech spans of sessions without turns. Sessions without turns take the
    loudness path, sessions without transcript keep the acoustic metrics: both are ordinary
    joins, so one job covers every kind of session.
    """

    sessions: DataFrame
    recordings: DataFrame
    turns: DataFrame
    segments: DataFrame
    transcripts: DataFrame
    measure: Callable[[DataFrame], DataFrame]
    voice: DataFrame | None = None
    lexicon: Sequence[str] = QUESTION_WORDS
    minutes: float | None = None
    split: bool | None = None
    thresholds: Thresholds = field(default_factory=lambda: DEFAULTS)

    def __post_init__(self):
        self.full_recordings = self.recordings
        if self.minutes is not None:
            edge = float(self.minutes * 60)
            self.recordings = intervals.window_recordings(self.recordings, edge)
            self.turns = intervals.window_turns(self.turns, edge)
            self.segments = intervals.window_turns(self.segments, edge)
        if self.split is None:
            self.split = needs_split(self.turns, ["session_id"])

    def release(self) -> None:
        """Forget all tables: they are made anew if they are used again. What is written stays in the shared folder."""
        for name in [n for n in vars(self) if isinstance(getattr(type(self), n, None), cached_property)]:
            del self.__dict__[name]

    @cached_property
    def main(self) -> DataFrame:
        return settled(intervals.main_speaker(self.turns))

    @cached_property
    def marked(self) -> DataFrame:
        return settled(intervals.mark_roles(self.turns, self.main, self.split))

    @cached_property
    def corpus(self) -> DataFrame:
        return corpus.build_corpus(self.sessions, self.full_recordings)

    @cached_property
    def timeline(self) -> DataFrame:
        """Tiles by kind; spans come from turns where there are any, else from ``voice``."""
        spans = self.marked.select("session_id", "start", "end")
        if self.voice is not None:
            rest = self.voice.join(spans.select("session_id").distinct(), "session_id", "left_anti")
            spans = spans.unionByName(rest.select("session_id", "start", "end"))
        merged = intervals.clip_and_union(spans, self.recordings, self.split)
        tiles = intervals.tile(merged, self.recordings, self.split)
        return settled(intervals.classify(self.measure(tiles), self.thresholds))

    @cached_property
    def labelled(self) -> DataFrame:
        # Speech tiles are unions of turns, so every one of them is covered.
        conf = intervals.clear_lead_confidence(self.main)
        rows = intervals.split_by_role(self.timeline, self.marked, conf, self.split, self.thresholds)
        if self.voice is not None:
            known = self.marked.select("session_id").distinct()
            quiet = self.timeline.join(known, "session_id", "left_anti")
            by_loudness = attribution.roles_from_loudness(quiet).drop("segment_ix")
            rows = rows.join(known, "session_id", "left_semi").unionByName(by_loudness)
        return settled(rows)

    @cached_property
    def discourse(self) -> DataFrame:
        marked = self.marked
        if self.voice is not None:
            rest = self.labelled.join(marked.select("session_id").distinct(), "session_id", "left_anti")
            marked = marked.unionByName(discourse.pseudo_turns(rest, self.split))
        return settled(discourse.discourse(marked, self.segments, self.lexicon, self.split, self.thresholds))

    @cached_property
    def acoustic(self) -> DataFrame:
        """Facts, confidence and the values that rest on the timeline: no question is looked for."""
        stats = metrics.transcript_stats(self.segments, self.transcripts)
        sessions = self.sessions.join(self.full_recordings.select(
            "session_id", F.col("actual_sec").alias("measured_sec")), "session_id")
        facts = metrics.session_facts(self.labelled, sessions, self.recordings, stats, None,
                                      self.split, self.thresholds)
        return settled(metrics.acoustic_values(facts, self.thresholds))

    @cached_property
    def facts(self) -> DataFrame:
        return self.acoustic.join(discourse.discourse_totals(self.discourse), "session_id", "left")

    @cached_property
    def values(self) -> DataFrame:
        return settled(metrics.metric_values(self.facts, self.thresholds))

    @cached_property
    def acoustic_metrics(self) -> DataFrame:
        """The rows of ``metrics`` that rest on the timeline."""
        return metrics.metric_rows(self.acoustic, self.thresholds, ACOUSTIC_KEYS)

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.metric_rows(self.values, self.thresholds)

    @cached_property
    def insight(self) -> DataFrame:
        return insight.message(insight.insight(self.values, self.corpus, self.thresholds), self.thresholds)

    @cached_property
    def published_timeline(self) -> DataFrame:
        return report.published_timeline(self.labelled, self.segments, self.split)

    @cached_property
    def silent_timeline(self) -> DataFrame:
        """The published timeline for readers of times, kinds and roles: text is null, so no transcript is joined."""
        return report.published_timeline(self.labelled, None, self.split)

    @cached_property
    def documents(self) -> DataFrame:
        lost = metrics.lost_students(self.marked, self.labelled, self.thresholds)
        known = self.marked.select("session_id").distinct().withColumn("from_turns", F.lit(True))
        values = self.values.join(known, "session_id", "left")
        return report.result_documents(self.corpus, values, self.metrics, self.insight, self.transcripts, lost)
