"""Comparing transcribers: without references (bake-off) and against references (benchmark)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from turnlake.config import ARTEFACT_PATTERNS, DEVANAGARI
from turnlake.operators import scoring


def bakeoff(rows: DataFrame, script: str = DEVANAGARI,
            patterns: Mapping[str, Sequence[str]] = ARTEFACT_PATTERNS) -> DataFrame:
    """Signals, composite and agreement for every row that has text.

    Needs clip_id, label, text, audio_sec, mean_logprob, speech_density and elapsed_sec.
    """
    signals = scoring.text_signals(rows.filter("text is not null"), script, patterns)
    return scoring.agreement(signals.withColumn("composite", scoring.composite()))


def ranking(rows: DataFrame, **kwargs) -> DataFrame:
    return scoring.rank_contenders(bakeoff(rows, **kwargs))


def benchmark(samples: DataFrame, outputs: DataFrame, backends: Sequence[str] | None = None) -> DataFrame:
    """Corpus error rates per backend, best first; of the backends asked, if they are named."""
    return scoring.rank_backends(scoring.score_backends(samples, outputs, backends))
