"""Interval operators: union, tiling, overlap winners, splitting speech at speaker changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from turnlake.config import DEFAULTS, Thresholds
from turnlake.functions.numbers import clamp
from turnlake.functions.signal import FLOOR, flatness_of, rms_db_of
from turnlake.ranges import BUCKET_SEC, in_buckets, overlap_join
from turnlake.scan import Ordered, following, last_value, previous, running_max, running_sum

SESSION = ["session_id"]


# --------------------------------------------------------------------------- union, tiling
def union_spans(turns: DataFrame, split: bool | None = None) -> DataFrame:
    """Merge overlapping or touching intervals; empty and inverted ones are dropped."""
    rows = turns.select("session_id", "start", "end").filter(F.col("end") > F.col("start"))
    runs = Ordered(rows, SESSION, ["start", "end"], split)
    runs = runs.with_columns(_reach=running_max(F.col("end")))
    opens = F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))
    runs = runs.with_columns(_span=last_value(F.when(opens, F.col("start")), inclusive=True))
    return (runs.df.groupBy("session_id", "_span").agg(F.max("end").alias("end"))
            .withColumnRenamed("_span", "start"))


def clip_and_union(turns: DataFrame, recordings: DataFrame,
                   split: bool | None = None) -> DataFrame:
    """Clamp intervals to [0, actual_sec], then merge them."""
    clipped = turns.join(recordings.select("session_id", "actual_sec"), "session_id").select(
        "session_id",
        F.greatest(F.col("start"), F.lit(0.0)).alias("start"),
        F.least(F.col("end"), F.col("actual_sec")).alias("end"))
    return union_spans(clipped, split)


def tile(spans: DataFrame, recordings: DataFrame, split: bool | None = None) -> DataFrame:
    """Speech spans and the silence around them: every second of [0, actual_sec], once.

    ``spans`` must be merged and clipped. A session without spans is one silent tile.
    """
    rows = recordings.select("session_id", "actual_sec").join(spans, "session_id", "left")
    near = Ordered(rows, SESSION, ["start"], split).with_columns(
        _before=previous(F.col("end")), _after=following(F.col("start")))
    start, end, total = F.col("start"), F.col("end"), F.col("actual_sec")

    def piece(a: Column, b: Column, speech: bool) -> Column:
        return F.struct(a.alias("start"), b.alias("end"), F.lit(speech).alias("is_speech"))

    pieces = F.array(
        piece(F.coalesce("_before", F.lit(0.0)), F.coalesce(start, total), False),
        piece(start, end, True),
        F.when(F.col("_after").isNull() & end.isNotNull(), piece(end, total, False)))
    tiles = near.map(lambda df: df.select(
        "session_id", *[c for c in df.columns if c.startswith("_block")],
        F.explode(F.filter(pieces, lambda p: p["end"] > p["start"])).alias("p")
    ).select("*", "p.*").drop("p"))
    numbered = tiles.with_columns(_n=running_sum(F.lit(1)))
    return numbered.df.select("session_id", (F.col("_n") - 1).cast("int").alias("segment_ix"),
                              "start", "end", "is_speech")


def non_speech_kind(rms_db: Column, t: Thresholds = DEFAULTS) -> Column:
    """Loud non-speech is hands-on work, quiet non-speech is dead air."""
    return F.when(rms_db >= t.handson_rms_db, "handson").otherwise("dead")


def measured(tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """Loudness and spectral flatness of each tile from the frames that begin in it.

    ``frames`` has session_id, at (start in seconds), samples, energy (sum of squared samples), bins,
    power (sum over the bins of the spectrum) and log_power (sum of their logarithms). A frame counts in
    the tile it begins in. A tile without frames is -120 dB and flatness 0.
    """
    heard = frames.select(F.col("session_id").alias("_sid"), "at", "samples", "energy", "bins", "power", "log_power",
                          F.floor(F.col("at") / F.lit(BUCKET_SEC)).alias("_at_bucket"))
    inside = ((F.col("session_id") == F.col("_sid")) & (F.col("_bucket") == F.col("_at_bucket"))
              & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    sums = in_buckets(tiles.select("session_id", "segment_ix", "start", "end"), "start", "end").join(heard, inside).groupBy(
        "session_id", "segment_ix").agg(*[F.sum(c).alias(f"_{c}") for c in ("samples", "energy", "bins", "power", "log_power")])
    rms = F.sqrt(F.col("_energy") / F.col("_samples"))
    flat = F.exp(F.col("_log_power") / F.col("_bins")) / F.greatest(F.col("_power") / F.col("_bins"), F.lit(FLOOR))
    out = tiles.join(sums, ["session_id", "segment_ix"], "left")
    return out.withColumn("rms_db", F.when(F.col("_samples") > 0, 20.0 * F.log10(F.greatest(rms, F.lit(FLOOR)))).otherwise(-120.0)).withColumn(
        "flatness", F.when(F.col("_power") > 0, clamp(flat)).otherwise(0.0)).drop(
        "_samples", "_energy", "_bins", "_power", "_log_power")


def measured_samples(tiles: DataFrame, waves: DataFrame, rate: int) -> DataFrame:
    """Loudness and spectral flatness of each tile from its own samples, the spectrum being that of the whole tile.

    ``waves`` holds the recordings in blocks of any length: session_id, first (place of the block's first sample
    in the recording), samples. Blocks must not overlap; null samples count as 0. A tile has the samples from
    floor(start * rate) up to floor(end * rate), as far as there are any; without samples it is -120 dB and
    flatness 0, as with fewer than 32 for flatness.

    Blocks meet tiles in buckets of time and are cut to them before they travel, so each sample is shuffled
    once per tile it lies in. Pieces stream past in order and a task holds one tile at a time: a spectrum
    needs its whole tile, about 50 bytes a sample, so 50 MB per minute at 16,000 samples a second.
    """
    keys = ["session_id", "segment_ix"]
    at = lambda t: F.floor(F.col(t) * F.lit(rate))
    asked = tiles.select(*keys, at("start").alias("_from"), at("end").alias("_to")).filter(F.col("_to") > F.col("_from"))
    blocks = waves.filter(F.size("samples") > 0).select(
        "session_id", F.col("first").alias("_first"), (F.col("first") + F.size("samples")).alias("_past"), "samples")
    met = overlap_join(asked, blocks, SESSION, ("_from", "_to"), ("_first", "_past"), width=BUCKET_SEC * rate)
    skipped = F.greatest(F.col("_from") - F.col("_first"), F.lit(0))
    length = F.least("_to", "_past") - F.greatest("_from", "_first")
    pieces = met.select(*keys, F.greatest("_from", "_first").alias("_at"),
                        F.slice(F.col("samples").cast("array<double>"), (skipped + 1).cast("int"), length.cast("int")).alias("samples"))
    ordered = pieces.repartition(*keys).sortWithinPartitions(*keys, "_at")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def figures() -> pa.RecordBatch:
            wave = parts[0] if len(parts) == 1 else np.concatenate(parts)
            values = [*key, rms_db_of(float(np.dot(wave, wave)), len(wave)), float(flatness_of(wave[None, :])[0])]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=fields)

        fields = pa.schema([*kinds, ("rms_db", pa.float64()), ("flatness", pa.float64())])
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            lists = batch.column("samples")
            for row, now in enumerate(ids):
                if now != key and parts:
                    yield figures()
                    parts = []
                key = now
                values = lists[row].values
                parts.append(values.fill_null(0.0).to_numpy(zero_copy_only=False).copy())
        if parts:
            yield figures()

    kinds = list(to_arrow_schema(pieces.select(*keys).schema))
    schema = T.StructType([*pieces.select(*keys).schema.fields, T.StructField("rms_db", T.DoubleType()), T.StructField("flatness", T.DoubleType())])
    found = ordered.select(*keys, "samples").mapInArrow(measure, schema)
    return tiles.drop("rms_db", "flatness").join(found, keys, "left").withColumns({
        "rms_db": F.coalesce("rms_db", F.lit(-120.0)), "flatness": F.coalesce("flatness", F.lit(0.0))})


def classify(tiles: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Name each tile speech, handson or dead from its ``rms_db``."""
    kind = F.when(F.col("is_speech"), "speech").otherwise(non_speech_kind(F.col("rms_db"), t))
    return tiles.withColumn("kind", kind).drop("is_speech")


# --------------------------------------------------------------------------- overlap winners
def _candidates(spans: DataFrame, turns: DataFrame, how: str = "inner") -> DataFrame:
    right = turns.select("session_id", "turn_ix", "speaker",
                         F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    pairs = overlap_join(spans, right, SESSION, ("start", "end"), ("t_start", "t_end"), how=how)
    overlap = F.least("end", "t_end") - F.greatest("start", "t_start")
    length = F.col("t_end") - F.col("t_start")
    pairs = pairs.withColumn("overlap", overlap)
    if how == "inner":
        pairs = pairs.filter(F.col("overlap") > 0)
    return pairs.withColumn("containment", F.when(length > 0, F.col("overlap") / length).otherwise(1.0))


def _first_most_contained() -> Column:
    return F.struct(F.col("containment"), (-F.col("turn_ix")).alias("rank"), F.col("speaker"))


def speaker_for_spans(spans: DataFrame, turns: DataFrame, span_key: list[str],
                      t: Thresholds = DEFAULTS) -> DataFrame:
    """The speaker of the single turn overlapping each span most; uncovered spans get none.

    Overlaps within the tolerance count as tied, ties go to the turn most contained in the
    span, then to the earlier turn. Candidates are first folded into cells one tolerance
    wide, so a span crossed by very many turns is reduced before it reaches one task. The
    rule walks the turns in order and is not transitive: where tied overlaps chain over more
    than one tolerance, that walk itself is taken (``_walk``).
    """
    tol = t.tie_sec
    slim = spans.select("session_id", *span_key, "start", "end")
    keys = ["session_id", *span_key]
    cells = (_candidates(slim, turns)
             .groupBy(*keys, F.floor(F.col("overlap") / tol).alias("_cell"))
             .agg(F.max(_first_most_contained()).alias("best"),
                  F.min("overlap").alias("low"), F.max("overlap").alias("high")))
    # Four cells are enough to see whether the tied run at the top stays within one tolerance.
    down = Window.partitionBy(*keys).orderBy(F.col("_cell").desc())
    ranked = (cells.withColumn("_rank", F.row_number().over(down)).filter(F.col("_rank") <= 4)
              .withColumn("_gap", F.lag("low").over(down) - F.col("high"))
              .withColumn("_run", F.sum(F.when(F.col("_gap") > tol, 1).otherwise(0)).over(down))
              .filter(F.col("_run") == 0))
    winners = ranked.groupBy(*keys).agg(
        F.max("best").alias("best"), (F.max("high") - F.min("low")).alias("spread"))
    plain = winners.filter(F.col("spread") <= tol).select(*keys, F.col("best.speaker").alias("speaker"))
    chained = winners.filter(F.col("spread") > tol).select(*keys)
    return plain.unionByName(_walk(slim.join(chained, keys, "left_semi"), turns, keys, tol))


def _walk(spans: DataFrame, turns: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """The rule taken turn by turn: a leader is followed by the first later turn that beats it.

    Sorted batches stream past; the leader of the span that a batch breaks off in is the state.
    """
    rows = _candidates(spans, turns).select(*keys, "turn_ix", "overlap", "containment", "speaker")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "turn_ix")

    def last_leader(overlap: np.ndarray, inside: np.ndarray, reach: float, share: float) -> int:
        """Place of the last leader after one with these values, -1 if none beats it."""
        leader, begin = -1, 0
        while begin < len(overlap):
            ahead = overlap[begin:] - reach
            beats = np.flatnonzero((ahead > tol) | ((np.abs(ahead) <= tol) & (inside[begin:] > share)))
            if not len(beats):
                break
            leader = begin + int(beats[0])
            reach, share, begin = overlap[leader], inside[leader], leader + 1
        return leader

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, led = None, (0.0, 0.0, None)
        for batch in batches:
            if batch.empty:
                continue
            done = []
            same = (batch[keys] == batch[keys].shift()).all(axis=1).to_numpy()
            edges = [0, *(np.flatnonzero(~same[1:]) + 1).tolist(), len(batch)]
            overlap, inside = batch["overlap"].to_numpy(), batch["containment"].to_numpy()
            for a, b in zip(edges[:-1], edges[1:]):
                key = tuple(batch[k].iat[a] for k in keys)
                if key != open_key:
                    if open_key is not None:
                        done.append((*open_key, led[2]))
                    open_key, led = key, (0.0, 0.0, None)
                at = last_leader(overlap[a:b], inside[a:b], led[0], led[1])
                if at >= 0:
                    led = (overlap[a + at], inside[a + at], batch["speaker"].iat[a + at])
            yield pd.DataFrame(done, columns=[*keys, "speaker"])
        if open_key is not None:
            yield pd.DataFrame([(*open_key, led[2])], columns=[*keys, "speaker"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ordered.mapInPandas(walk, ", ".join(f"{c} {fields[c]}" for c in [*keys, "speaker"]))


# --------------------------------------------------------------------------- main speaker
def main_speaker(turns: DataFrame) -> DataFrame:
    """Per session the speaker with most time, and how clear the lead is (0..1).

    The first-seen speaker wins a tie. ``row_number() <= 2`` is pruned before the shuffle.
    """
    totals = turns.groupBy("session_id", "speaker").agg(
        F.sum(F.col("end") - F.col("start")).alias("sec"), F.min("turn_ix").alias("first_ix"))
    rank = Window.partitionBy("session_id").orderBy(F.col("sec").desc(), F.col("first_ix"))
    top = totals.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= 2)
    first, second = F.max(F.when(F.col("n") == 1, F.col("sec"))), F.max(F.when(F.col("n") == 2, F.col("sec")))
    both = first + second
    margin = F.when(second.isNull(), 1.0).when(both > 0, (first - second) / both).otherwise(0.0)
    return top.groupBy("session_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("speaker"))).alias("main_speaker"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin)).alias("margin"))


def collapse_role(speaker: Column, main: Column) -> Column:
    """Main speaker is the teacher; every other voice is a student; no voice stays null."""
    return F.when(speaker.isNotNull(), F.when(speaker == main, "teacher").otherwise("student"))


def coverage_confidence(timeline: DataFrame, turns: DataFrame, main: DataFrame) -> DataFrame:
    """Share of speech segments some turn covers, scaled by how clear the main speaker is."""
    speech = timeline.filter(F.col("kind") == "speech").select(
        "session_id", "segment_ix", "start", "end")
    covered = _candidates(speech, turns).select("session_id", "segment_ix").distinct()
    share = (speech.join(covered.withColumn("hit", F.lit(1)), ["session_id", "segment_ix"], "left")
             .groupBy("session_id")
             .agg((F.count("hit") / F.count(F.lit(1))).alias("coverage")))
    return (share.join(main, "session_id", "left")
            .select("session_id", "coverage",
                    (F.col("coverage") * (0.5 + 0.5 * F.coalesce("margin", F.lit(0.0))))
                    .alias("confidence")))


# --------------------------------------------------------------------------- labelling
def label_whole_segments(timeline: DataFrame, turns: DataFrame, main: DataFrame) -> DataFrame:
    """Give each speech segment the role of whoever overlaps it most."""
    speech = timeline.filter(F.col("kind") == "speech")
    winner = speaker_for_spans(speech, turns, ["segment_ix"])
    conf = coverage_confidence(timeline, turns, main).select("session_id", "confidence")
    rows = (timeline.join(winner, ["session_id", "segment_ix"], "left")
            .join(main.select("session_id", "main_speaker"), "session_id", "left")
            .join(conf, "session_id", "left"))
    role = collapse_role(F.col("speaker"), F.col("main_speaker"))
    return (rows.withColumn("role", role)
            .withColumn("role_conf", F.when(F.col("role").isNotNull(), F.col("confidence")))
            .drop("speaker", "main_speaker", "confidence"))


def cut_at_turn_edges(timeline: DataFrame, turns: DataFrame, split: bool | None = None,
                      t: Thresholds = DEFAULTS) -> DataFrame:
    """Cut speech segments at every turn edge strictly inside; drop slivers.

    Segments do not overlap, so segments and edges go on one clock, a segment before the edges at
    its start: an edge belongs to the segment before it if that lasts longer, and a piece ends with
    the next point or its segment. No pairs are formed. An edge that several turns share makes
    pieces of no length, which go with the slivers.
    """
    tiles = timeline.filter(F.col("kind") == "speech").select(
        "session_id", F.col("start").alias("at"), F.lit(0).alias("point"), F.struct("segment_ix", "end").alias("tile"))
    edges = turns.select("session_id", F.explode(F.array("start", "end")).alias("at"), F.lit(1).alias("point"),
                         F.lit(None).cast(tiles.schema["tile"].dataType).alias("tile"))
    clock = Ordered(tiles.unionByName(edges), SESSION, ["at", "point"], split).with_columns(
        _tile=last_value(F.col("tile"), inclusive=True), _next=following(F.col("at")))
    pieces = clock.df.filter(F.col("at") < F.col("_tile.end")).select(
        "session_id", "_tile.segment_ix", F.col("at").alias("start"), F.least("_next", "_tile.end").alias("end"))
    return pieces.filter((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= t.min_piece_sec))


def speaker_of_pieces(pieces: DataFrame, turns: DataFrame) -> DataFrame:
    """Who speaks in each piece cut by ``cut_at_turn_edges``; null where nobody does.

    No turn edge lies inside a piece, so every overlapping turn covers it completely and all
    overlaps are equal: the winner is the most contained turn, the earlier one on a tie. One
    partial aggregation decides it.
    """
    keys = ["session_id", "segment_ix", "start", "end"]
    found = _candidates(pieces.select(*keys), turns, "left")
    best = F.max(F.when(F.col("turn_ix").isNotNull(), _first_most_contained()))
    return found.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.speaker").alias("speaker"))


def merge_adjacent(pieces: DataFrame, split: bool | None = None,
                   t: Thresholds = DEFAULTS) -> DataFrame:
    """Join neighbouring pieces of one role; a short unattributed piece joins what precedes it.

    Pieces of a segment must be in ``start`` order. The first piece's values are kept.
    """
    short = F.col("end") - F.col("start") <= t.merge_gap_sec
    stated = F.when(F.col("role").isNotNull(), F.col("role")).when(~short, "none")
    runs = Ordered(pieces, ["session_id", "segment_ix"], ["start"], split)
    runs = runs.with_columns(_stated=last_value(stated, inclusive=True))
    runs = runs.map(lambda df: df.withColumn("_held", F.coalesce("_stated", F.lit("none"))))
    runs = runs.with_columns(_was=previous(F.col("_held")))
    opens = F.col("_was").isNull() | (F.col("_was") != F.col("_held"))
    runs = runs.with_columns(_run=last_value(F.when(opens, F.col("start")), inclusive=True))
    return (runs.df.groupBy("session_id", "segment_ix", F.col("_run").alias("start"), "_held")
            .agg(F.max("end").alias("end"))
            .select("session_id", "segment_ix", "start", "end",
                    F.when(F.col("_held") != "none", F.col("_held")).alias("role")))


def restretch(timeline: DataFrame, merged: DataFrame, split: bool | None = None) -> DataFrame:
    """Stretch merged pieces over the holes slivers left, so a segment's pieces tile it again.

    Tiles and pieces go on one clock, a tile right before its pieces. A piece starts with its
    tile or where it is, and ends with the next piece or its tile; a tile without pieces stays
    as it is, unattributed. Merging a second time would change nothing: neighbours already
    differ in role, and stretching only lengthens pieces, so no unattributed one becomes short
    enough to be absorbed.
    """
    tile_columns = [c for c in timeline.columns if c != "session_id"]
    tiles = timeline.select(
        "session_id", "start", F.lit(0).alias("piece"), F.struct(*tile_columns).alias("tile"),
        F.lit(None).cast("string").alias("role"))
    pieces = merged.select("session_id", "start", F.lit(1).alias("piece"),
                           F.lit(None).cast(tiles.schema["tile"].dataType).alias("tile"), "role")
    at = F.struct("piece", "start")
    clock = Ordered(tiles.unionByName(pieces), SESSION, ["start", "piece"], split).with_columns(
        _before=previous(at), _after=following(at), _tile=last_value(F.col("tile"), inclusive=True))
    is_piece, more = F.col("piece") == 1, F.coalesce(F.col("_after.piece") == 1, F.lit(False))
    others = [c for c in tile_columns if c not in ("start", "end")]
    return clock.df.filter(is_piece | ~more).select(
        "session_id",
        F.when(is_piece & (F.col("_before.piece") == 1), F.col("start")).otherwise(F.col("_tile.start")).alias("start"),
        F.when(is_piece & more, F.col("_after.start")).otherwise(F.col("_tile.end")).alias("end"),
        *[F.col(f"_tile.{c}").alias(c) for c in others], "role")


def mark_roles(turns: DataFrame, main: DataFrame, split: bool | None = None) -> DataFrame:
    """Turns with the role of their speaker and the number of student turns before them.

    Consecutive teacher turns share that number, which makes it the id of their run.
    """
    roles = turns.join(main.select("session_id", "main_speaker"), "session_id").select(
        "session_id", "turn_ix", "start", "end", "speaker",
        collapse_role(F.col("speaker"), F.col("main_speaker")).alias("role"))
    return Ordered(roles, SESSION, ["start", "turn_ix"], split).with_columns(
        run=running_sum(F.when(F.col("role") == "student", 1).otherwise(0))).df


def clear_lead_confidence(main: DataFrame) -> DataFrame:
    """Confidence where every speech segment is covered, as when it was built from the turns."""
    return main.select("session_id", (0.5 + 0.5 * F.col("margin")).alias("confidence"))


def split_by_role(timeline: DataFrame, marked: DataFrame, conf: DataFrame,
                  split: bool | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """The labelled timeline: speech cut at speaker changes, roles attached, tiling kept.

    ``marked`` comes from ``mark_roles``, ``conf`` gives each session's confidence.
    """
    voices = marked.select("session_id", "turn_ix", "start", "end", F.col("role").alias("speaker"))
    pieces = speaker_of_pieces(cut_at_turn_edges(timeline, voices, split, t), voices)
    merged = merge_adjacent(pieces.withColumnRenamed("speaker", "role"), split, t)
    out = restretch(timeline, merged, split).join(conf.select("session_id", "confidence"), "session_id", "left")
    return out.withColumn("role_conf", F.when(F.col("role").isNotNull(), F.col("confidence"))).drop(
        "confidence", "segment_ix")


def split_by_speaker(timeline: DataFrame, turns: DataFrame, main: DataFrame,
                     split: bool | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """``split_by_role`` from plain turns, with confidence from measured coverage."""
    return split_by_role(timeline, mark_roles(turns, main, split),
                         coverage_confidence(timeline, turns, main), split, t)


def numbered(rows: DataFrame, split: bool | None = None, name: str = "seg_no") -> DataFrame:
    """Zero-based position of each timeline row within its session."""
    ordered = Ordered(rows, SESSION, ["start"], split).with_columns(_n=running_sum(F.lit(1)))
    return ordered.df.withColumn(name, (F.col("_n") - 1).cast("int")).drop("_n")


def text_of_spans(spans: DataFrame, segments: DataFrame, span_key: list[str]) -> DataFrame:
    """What the transcript says inside each span, in segment order; null where nothing."""
    words = segments.filter(F.col("text") != "").select(
        "session_id", "seg_ix", "text", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    slim = spans.select("session_id", *span_key, "start", "end")
    pairs = overlap_join(slim, words, SESSION, ("start", "end"), ("s_start", "s_end"))
    listed = pairs.groupBy("session_id", *span_key).agg(
        F.array_sort(F.collect_list(F.struct("seg_ix", "text"))).alias("xs"))
    return listed.select("session_id", *span_key,
                         F.array_join(F.transform("xs", lambda x: x["text"]), " ").alias("text"))


def talk_time(timeline: DataFrame) -> DataFrame:
    """Seconds per bucket; every row falls in exactly one, an absent bucket is 0."""
    sec = F.col("end") - F.col("start")
    speech = F.col("kind") == "speech"
    role = F.coalesce(F.col("role"), F.lit("none"))

    def bucket(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, sec).otherwise(0.0)).alias(name)

    return timeline.groupBy("session_id").agg(
        bucket(speech & (role == "teacher"), "teacher_sec"),
        bucket(speech & (role == "student"), "student_sec"),
        bucket(F.col("kind") == "handson", "handson_sec"),
        bucket(F.col("kind") == "dead", "dead_sec"),
        bucket(speech & ~role.isin("teacher", "student"), "unattributed_sec"))


def window_turns(turns: DataFrame, seconds: float) -> DataFrame:
    """Turns inside the first ``seconds`` of each session, cut at the edge."""
    return (turns.filter(F.col("start") < seconds)
            .withColumn("end", F.least("end", F.lit(float(seconds)))))


def window_recordings(recordings: DataFrame, seconds: float) -> DataFrame:
    """Recordings as analysed: at most the first ``seconds``."""
    return recordings.withColumn("actual_sec", F.least("actual_sec", F.lit(float(seconds))))
