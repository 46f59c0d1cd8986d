"""Planning and stitching of chunks and clips, and rebuilding segments from tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, Thresholds
from turnlake.functions.numbers import round_even
from turnlake.functions.text import strip
from turnlake.scan import Ordered, following, last_value, previous, running_sum

SESSION = ["session_id"]


def plan_chunks(recordings: DataFrame, chunk_sec: float, overlap_sec: float = 0.0,
                min_tail_sec: float | None = None) -> DataFrame:
    """Pieces of at most ``chunk_sec`` covering each recording, starts pulled back.

    A rest shorter than ``min_tail_sec`` (5 % of a chunk) lengthens the piece before it.
    """
    if chunk_sec <= 0:
        raise ValueError("chunk_sec must be positive")
    if overlap_sec < 0 or overlap_sec >= chunk_sec:
        raise ValueError("overlap_sec must lie in [0, chunk_sec)")
    tail = chunk_sec * 0.05 if min_tail_sec is None else min_tail_sec
    total = F.when(F.col("actual_sec") > 0, F.col("actual_sec")).otherwise(
        F.raise_error(F.lit("actual_sec must be positive")).cast("double"))
    pieces = F.ceil((total - 1e-9) / chunk_sec)
    rest = total - (pieces - 1) * chunk_sec
    count = F.when((pieces > 1) & (rest < tail), pieces - 1).otherwise(pieces)
    rows = recordings.select("session_id", total.alias("total"), count.alias("n"))
    rows = rows.select("session_id", "total", "n",
                       F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    start = F.when(F.col("i") == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.col("i") * F.lit(float(chunk_sec)) - overlap_sec))
    end = F.when(F.col("i") == F.col("n") - 1, F.col("total")).otherwise(
        (F.col("i") + 1) * F.lit(float(chunk_sec)))
    return rows.select("session_id", F.col("i").cast("int").alias("chunk_ix"),
                       start.alias("start"), (end - start).alias("duration"))


def select_clips(recordings: DataFrame, n_clips: int, clip_sec: float,
                 margin: float = 0.05) -> DataFrame:
    """Evenly spaced, non-overlapping clips inside the margins; fewer where they do not fit."""
    if n_clips <= 0 or clip_sec <= 0:
        raise ValueError("n_clips and clip_sec must be positive")
    total = F.col("actual_sec")
    left = total * F.lit(margin)
    span = total * F.lit(1.0 - margin) - left
    whole = total <= clip_sec
    fits = F.floor(span / clip_sec)
    fits = F.when(fits * clip_sec > span, fits - 1).otherwise(fits)
    count = F.when(whole, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(n_clips), fits.cast("int"))))
    rows = recordings.filter(total > 0).select(
        "session_id", total.alias("total"), left.alias("left"), whole.alias("whole"),
        ((span - count * clip_sec) / (count + 1)).alias("gap"),
        F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    start = F.col("left") + F.col("gap") * (F.col("i") + 1) + F.lit(float(clip_sec)) * F.col("i")
    return rows.select(
        "session_id", F.col("i").alias("clip_ix"),
        F.concat(F.col("session_id").cast("string"), F.lit("_c"),
                 F.lpad(F.col("i").cast("string"), 2, "0")).alias("clip_id"),
        F.when(F.col("whole"), 0.0).otherwise(round_even(start, 3)).alias("start"),
        F.when(F.col("whole"), F.col("total")).otherwise(F.lit(float(clip_sec))).alias("duration"))


def shift(segments: DataFrame, by: Column) -> DataFrame:
    """Move segments, and any words inside them, along the clock."""
    out = segments.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by)
    if "words" in segments.columns:
        moved = F.transform("words", lambda w: F.struct(
            (w["start"] + by).alias("start"), (w["end"] + by).alias("end"), w["word"].alias("word")))
        out = out.withColumn("words", F.when(F.size("words") > 0, moved))
    return out


def chunk_counts(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sessions whose parts do not match their planned chunks one to one."""
    got = parts.select("session_id", "chunk_ix").distinct().withColumn("got", F.lit(1))
    planned = chunks.select("session_id", "chunk_ix").withColumn("planned", F.lit(1))
    return (planned.join(got, ["session_id", "chunk_ix"], "full_outer").groupBy("session_id")
            .agg(F.count("planned").alias("planned"), F.count("got").alias("got"))
            .filter((F.col("planned") != F.col("got"))))


def place_parts(parts: DataFrame, part_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk segments in whole-recording time; a session whose parts differ stops the job.

    ``parts`` has one row per transcribed chunk, also for silent ones.
    """
    planned = chunks.select("session_id", "chunk_ix", F.col("start").alias("_offset"))
    differing = chunk_counts(parts, chunks).select("session_id", F.lit(True).alias("_differs"))
    rows = part_segments.join(planned, ["session_id", "chunk_ix"], "left").join(differing, "session_id", "left")
    stop = F.raise_error(F.concat(F.lit("parts and chunks differ in session "),
                                  F.col("session_id").cast("string"))).cast("double")
    by = F.when(F.col("_differs") | F.col("_offset").isNull(), stop).otherwise(F.col("_offset"))
    return shift(rows, by).drop("_offset", "_differs")


def drop_repeats(placed: DataFrame, split: bool | None = None,
                 t: Thresholds = DEFAULTS) -> DataFrame:
    """Drop a segment equal in text to the last kept one and within the tolerance of it.

    Whether a row is dropped can depend on the row before it only through a link: same text
    and at most two tolerances apart. An unlinked row is always kept, so only rows of linked
    chains, without their text, are walked in order. The walk streams sorted batches and
    holds one row of state however long a chain is.
    """
    order, tol = ["chunk_ix", "seg_ix"], t.duplicate_tolerance_sec
    rows = Ordered(placed, SESSION, order, split).with_columns(
        _text=previous(F.col("text")), _start=previous(F.col("start")))
    linked = (F.col("text") == F.col("_text")) & (F.abs(F.col("start") - F.col("_start")) <= 2 * tol)
    rows = rows.map(lambda df: df.withColumn("_linked", F.coalesce(linked, F.lit(False))))
    rows = rows.with_columns(_leads=following(F.col("_linked")),
                             _chain=running_sum(F.when(F.col("_linked"), 0).otherwise(1)))
    chains = (rows.df.filter(F.col("_linked") | F.col("_leads"))
              .select("session_id", "_chain", *order, "start")
              .repartition("session_id", "_chain")
              .sortWithinPartitions("session_id", "_chain", *order))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, 0.0
        for batch in batches:
            dropped = []
            for i, (sid, no, start) in enumerate(zip(batch["session_id"], batch["_chain"], batch["start"])):
                if (sid, no) == chain and abs(last - start) <= tol:
                    dropped.append(i)
                else:
                    chain, last = (sid, no), start
            yield batch.iloc[dropped][["session_id", *order]]

    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in ["session_id", *order])
    return placed.join(chains.mapInPandas(walk, schema), ["session_id", *order], "left_anti")


def renumbered(kept: DataFrame, split: bool | None = None) -> DataFrame:
    """Segments of all chunks of a recording counted on from 1, in the order of the chunks."""
    rows = Ordered(kept.withColumnRenamed("seg_ix", "_part_ix"), SESSION, ["chunk_ix", "_part_ix"], split).with_columns(
        seg_ix=running_sum(F.lit(1)))
    return rows.df.drop("_part_ix")


def language_vote(parts: DataFrame) -> DataFrame:
    """Language of the part with the highest probability; the earliest part wins a tie."""
    prob = F.coalesce("language_prob", F.lit(-1.0))
    best = parts.groupBy("session_id").agg(F.max(F.struct(
        prob.alias("p"), (-F.col("chunk_ix")).alias("ix"),
        F.col("language").alias("language"), F.col("language_prob").alias("language_prob"))).alias("b"))
    return best.select("session_id", "b.language", "b.language_prob")


def segments_from_tokens(tokens: DataFrame, gap_sec: float = DEFAULTS.token_gap_sec,
                         split: bool | None = None) -> DataFrame:
    """Timed segments from a token stream: a longer pause than ``gap_sec`` starts a new one.

    Needs session_id, token_ix, token, at, logprob and audio_sec. Text is the tokens joined
    bare; the end is the last stamp plus the shortest step of the run (0.2 s without one), at
    least 0.05 s, never past the recording.
    """
    rows = Ordered(tokens, SESSION, ["token_ix"], split).with_columns(_at=previous(F.col("at")))
    step = F.col("at") - F.col("_at")
    opens = F.col("_at").isNull() | (step > gap_sec)
    rows = rows.map(lambda df: df.withColumn("_step", F.when(~opens, step)).withColumn(
        "_open_ix", F.when(opens, F.col("token_ix"))))
    rows = rows.with_columns(run_ix=last_value(F.col("_open_ix"), inclusive=True))
    runs = rows.df.groupBy("session_id", "run_ix").agg(
        F.array_sort(F.collect_list(F.struct("token_ix", "token"))).alias("xs"),
        F.min_by("at", "token_ix").alias("start"), F.max_by("at", "token_ix").alias("last"),
        F.min("_step").alias("tail"), F.avg("logprob").alias("avg_logprob"),
        F.max("audio_sec").alias("audio_sec"))
    text = strip(F.array_join(F.transform("xs", lambda x: x["token"]), ""))
    end = F.least(F.col("last") + F.greatest(F.coalesce("tail", F.lit(0.2)), F.lit(0.05)), F.col("audio_sec"))
    return runs.select("session_id", "run_ix", "start", F.greatest(end, F.col("start")).alias("end"),
                       text.alias("text"), "avg_logprob").filter(F.col("text") != "")


def sweep_settings(frames: DataFrame, grid: Sequence[tuple[str, float, int, int]],
                   split: bool | None = None) -> DataFrame:
    """Speech coverage of every clip under every detector setting.

    ``frames`` has clip_id, frame_ix and score; each setting is (name, threshold, min_speech,
    min_silence), the last two in frames. Frames at or over the threshold are speech, shorter
    silences between them are bridged, then shorter speech is dropped.
    """
    setting = F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(float(thr)).alias("threshold"),
                                 F.lit(speech).alias("min_speech"), F.lit(max(1, silence)).alias("min_silence"))
                        for name, thr, speech, silence in grid])
    key = ["setting", "clip_id"]
    # Frames under every threshold are speech nowhere and need no copy per setting.
    heard = frames.filter(F.col("score") >= min(float(g[1]) for g in grid))
    voiced = heard.select("*", F.inline(setting)).filter(F.col("score") >= F.col("threshold"))
    runs = Ordered(voiced, key, ["frame_ix"], split).with_columns(_at=previous(F.col("frame_ix")))
    opens = F.col("_at").isNull() | (F.col("frame_ix") - F.col("_at") - 1 >= F.col("min_silence"))
    runs = runs.with_columns(_run=last_value(F.when(opens, F.col("frame_ix")), inclusive=True))
    spans = runs.df.groupBy(*key, "_run", "min_speech").agg(
        (F.max("frame_ix") - F.col("_run") + 1).alias("frames"))
    speech = spans.filter(F.col("frames") >= F.col("min_speech")).groupBy(*key).agg(
        F.sum("frames").alias("speech"))
    total = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("total")).select(
        "clip_id", "total", F.explode(F.array(*[F.lit(g[0]) for g in grid])).alias("setting"))
    return total.join(speech, key, "left").select(
        *key, (F.coalesce("speech", F.lit(0)) * 100.0 / F.col("total")).alias("coverage"))


def mean_by_setting(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("setting").agg(F.avg("coverage").alias("mean_coverage"))
