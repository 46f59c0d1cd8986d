"""One transcript per recording from the transcripts of its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, Thresholds
from turnlake.operators import sequences


def stitch(parts: DataFrame, part_segments: DataFrame, chunks: DataFrame, recordings: DataFrame,
           t: Thresholds = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Transcripts (language, backend, model, full length) and their segments in whole-recording time.

    ``parts`` has a row per transcribed chunk: session_id, chunk_ix, language, language_prob, backend, model.
    The language is the most probable part's; backend and model are the first part's. Segments that
    two chunks heard in their overlap come once, numbered anew.
    """
    placed = sequences.place_parts(parts, part_segments, chunks)
    kept = sequences.drop_repeats(placed, t=t)
    segments = sequences.renumbered(kept)
    first = parts.groupBy("session_id").agg(F.min_by(F.struct("backend", "model"), "chunk_ix").alias("p"))
    heads = (recordings.select("session_id", F.col("actual_sec").alias("audio_sec"))
             .join(sequences.language_vote(parts), "session_id").join(first, "session_id"))
    return heads.select("session_id", "language", "language_prob", "p.backend", "p.model", "audio_sec"), segments
