"""Error rates against references, reference-free quality signals, and contender ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.config import ARTEFACT_PATTERNS, DEFAULTS, DEVANAGARI, Thresholds
from turnlake.functions import text as tx
from turnlake.functions.numbers import clamp
from turnlake.operators import metrics


# --------------------------------------------------------------------------- error rates
def edit_counts(pairs: DataFrame) -> DataFrame:
    """Word and character edits and reference lengths of each reference/hypothesis pair."""
    ref, hyp = F.col("_ref"), F.col("_hyp")
    scored = pairs.withColumn("_ref", tx.for_scoring(F.col("reference"))).withColumn(
        "_hyp", tx.for_scoring(F.col("hypothesis")))
    bare = F.replace(ref, F.lit(" "), F.lit(""))
    return scored.withColumns({
        "word_edits": tx.word_edits(ref, hyp), "ref_words": F.size(tx.words(ref)),
        "char_edits": tx.char_edits(ref, hyp), "ref_chars": F.length(bare),
    }).drop("_ref", "_hyp")


def pair_rates(pairs: DataFrame) -> DataFrame:
    """wer and cer per pair; a reference that is empty after normalising stops the job."""
    def rate(edits: str, units: str) -> Column:
        empty = F.raise_error(F.lit("reference is empty after normalisation")).cast("double")
        return F.when(F.col(units) > 0, F.col(edits) / F.col(units)).otherwise(empty)

    return edit_counts(pairs).withColumn("wer", rate("word_edits", "ref_words")).withColumn(
        "cer", rate("char_edits", "ref_chars"))


def score_backends(samples: DataFrame, outputs: DataFrame, backends: Sequence[str] | None = None) -> DataFrame:
    """Corpus wer and cer per backend: total edits over total reference units.

    ``backends`` names those that were asked; one that answered nothing at all is reported too, with every
    sample failed, and rows of others are left out. Without it the backends are those with rows.
    A sample that a backend has no row for, or no text, has failed: it is counted and not scored. Empty
    text is a fully wrong answer. A backend without scored samples has null rates; one whose
    references are all empty stops the job. ``outputs`` has one row per sample and backend at most.
    """
    answers = outputs.join(samples, "sample_id")
    if backends is not None:
        if not backends:
            raise ValueError("no backends to score")
        kind = outputs.schema["backend"].dataType
        asked = samples.sparkSession.range(1).select(
            F.explode(F.array_distinct(F.array(*[F.lit(b).cast(kind) for b in backends]))).alias("backend"))
        answers = asked.join(answers, "backend", "left")
    edits = edit_counts(answers)
    every = samples.select(F.count(F.lit(1))).scalar()
    answered = F.col("hypothesis").isNotNull()
    scored = F.count_if(answered)

    def rate(edits_col: str, units: str) -> Column:
        kept = answered & (F.col(units) > 0)
        total = F.sum(F.when(kept, F.col(units)))
        empty = F.raise_error(F.lit("every reference was empty after normalisation")).cast("double")
        return F.when(scored == 0, None).when(
            total > 0, F.sum(F.when(kept, F.col(edits_col))) / total).otherwise(empty)

    return edits.groupBy("backend").agg(
        scored.alias("scored"), rate("word_edits", "ref_words").alias("wer"), rate("char_edits", "ref_chars").alias("cer"),
        F.sum("elapsed_sec").alias("elapsed_sec"),
        (F.sum("elapsed_sec") / F.greatest(F.lit(1), scored)).alias("sec_per_sample")).withColumn("failed", every - F.col("scored"))


def rank_backends(scores: DataFrame) -> DataFrame:
    """Position by wer, backends without one last. One row per backend, so one window is fine."""
    order = Window.orderBy(F.col("wer").asc_nulls_last(), "backend")
    return scores.withColumn("position", F.row_number().over(order))


def best_samples(pairs: DataFrame) -> DataFrame:
    """The sample with the lowest wer per backend; the smaller id on a tie."""
    rows = pair_rates(pairs.filter(F.col("hypothesis").isNotNull()))
    best = rows.groupBy("backend").agg(F.min(F.struct(
        "wer", "sample_id", "reference", "hypothesis")).alias("b"))
    return best.select("backend", "b.sample_id", "b.wer", "b.reference", "b.hypothesis")


def benchmark_samples(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows with both audio and a reference; others are passed over first."""
    reference = tx.strip(F.coalesce("reference", F.lit("")))
    usable = rows.withColumn("reference", reference).filter(
        (F.col("reference") != "") & (F.coalesce(F.octet_length("audio"), F.lit(0)) > 0))
    return usable.orderBy("sample_id").limit(n)


# --------------------------------------------------------------------------- signals
def text_signals(rows: DataFrame, script: str = DEVANAGARI,
                 patterns: Mapping[str, Sequence[str]] = ARTEFACT_PATTERNS) -> DataFrame:
    """Looping, compression, script and pattern signals of ``text`` over ``audio_sec``."""
    text = F.col("text")
    # The words are split once for both figures that need them.
    of_words = tx.bound(tx.words(text), lambda ws: F.struct(tx.repeated_share(ws).alias("repeated"), F.size(ws).alias("n")))
    return rows.withColumn("_words", of_words).withColumns({
        "repetition_rate": F.col("_words.repeated"),
        "compression_ratio": tx.compression_ratio(text),
        "script_ratio": tx.script_ratio(text, script),
        "words_per_sec": F.when(F.col("audio_sec") > 0, F.col("_words.n") / F.col("audio_sec")).otherwise(0.0),
        "artefacts": tx.artefact_hits(text, patterns),
        "chars": F.length(F.coalesce(text, F.lit(""))),
    }).drop("_words")


def transcript_signals(segments: DataFrame, transcripts: DataFrame, script: str = DEVANAGARI,
                       patterns: Mapping[str, Sequence[str]] = ARTEFACT_PATTERNS, t: Thresholds = DEFAULTS) -> DataFrame:
    """All signals of each transcript: those of its text and those of its segments.

    Whether it is empty and whether it compresses so hard that it must loop are told as well.
    """
    texts = metrics.transcript_text(segments)
    rows = metrics.transcript_stats(segments, transcripts).join(texts, "session_id", "left").join(
        transcripts.select("session_id", "audio_sec"), "session_id")
    return text_signals(rows, script, patterns).withColumn("is_empty", F.col("chars") == 0).withColumn(
        "compression_alarm", looping_alarm(t))


def composite(t: Thresholds = DEFAULTS) -> Column:
    """One 0..1 number for ranking, from the signal columns; nothing without text.

    A weighted mean of what speaks for a transcript, cut by a factor for each thing that speaks against it.
    """
    heard = F.col("mean_logprob")
    good = {"confidence": F.when(heard.isNull(), t.unknown_confidence).otherwise(clamp(1.0 + heard / t.logprob_range)),
            "density": clamp(F.col("speech_density")),
            "looping": 1.0 - clamp(F.col("repetition_rate")),
            "script": clamp(F.col("script_ratio"))}
    against = [F.when(F.size("artefacts") > 0, t.artefact_factor),
               F.when(F.col("words_per_sec") > t.max_plausible_wps,
                      F.greatest(F.lit(t.least_speed_factor), t.max_plausible_wps / F.col("words_per_sec")))]
    score = sum((F.lit(weight) * good[name] for name, weight in t.signal_weights.items()), F.lit(0.0))
    for factor in against:
        score = score * F.coalesce(factor, F.lit(1.0))
    return F.when(F.col("chars") > 0, clamp(score)).otherwise(0.0)


def looping_alarm(t: Thresholds = DEFAULTS) -> Column:
    return F.col("compression_ratio") > t.compression_alarm


# --------------------------------------------------------------------------- bake-off
def expected_rows(clips: DataFrame, contenders: Sequence[str]) -> DataFrame:
    """Every clip once per contender; the contender list is the caller's."""
    if not contenders:
        raise ValueError("no contenders to compare")
    return clips.withColumn("label", F.explode(F.array(*[F.lit(c) for c in contenders])))


def attempts(clips: DataFrame, contenders: Sequence[str], outputs: DataFrame) -> DataFrame:
    """All expected rows with their output; one without text is a recorded failure."""
    rows = expected_rows(clips, contenders).join(outputs, ["clip_id", "label"], "left")
    return rows.withColumn("failed", F.col("text").isNull())


def agreement(rows: DataFrame) -> DataFrame:
    """Mean word overlap of each row with the other contenders of its clip; null if alone.

    Texts are not met in pairs of rows: each word of a clip is listed once with the contenders that say it,
    pairs of contenders are counted over these lists, and what both say follows from the counts. A list is no
    longer than there are contenders. Of several rows of one (clip_id, label) the words of the least text
    stand for all, so a doubled row changes nothing.
    """
    key = ["clip_id", "label"]
    texts = rows.groupBy(*key).agg(F.min(F.coalesce("text", F.lit(""))).alias("_text"))
    bags = texts.select(*key, F.array_distinct(tx.words(F.col("_text"))).alias("_bag"))
    said = (bags.select(*key, F.explode("_bag").alias("_word")).groupBy("clip_id", "_word")
            .agg(F.array_sort(F.collect_list("label")).alias("_by")))
    pair = F.flatten(F.transform("_by", lambda a: F.transform(F.filter("_by", lambda b: b != a), lambda b: F.struct(
        a.alias("label"), b.alias("_other")))))
    shared = (said.filter(F.size("_by") > 1).select("clip_id", F.inline(pair)).groupBy("clip_id", "label", "_other")
              .agg(F.count(F.lit(1)).alias("_shared")))
    sizes = bags.select(*key, F.size("_bag").alias("_size"))
    line_up = sizes.groupBy("clip_id").agg(F.collect_list(F.struct(F.col("label").alias("_other"), F.col("_size").alias("_o_size"))).alias("_all"))
    pairs = sizes.join(line_up, "clip_id").select(*key, "_size", F.inline("_all")).filter(F.col("label") != F.col("_other"))
    both = F.coalesce("_shared", F.lit(0))
    either = F.col("_size") + F.col("_o_size") - both
    means = (pairs.join(shared, [*key, "_other"], "left").groupBy(*key)
             .agg(F.avg(F.when(either > 0, both / either).otherwise(0.0)).alias("agreement")))
    return rows.join(means, key, "left")


def rank_contenders(rows: DataFrame) -> DataFrame:
    """Mean signals per contender, best composite first; nulls stay out of the means."""
    scores = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("clips_scored"), F.avg("composite").alias("composite"),
        F.avg("agreement").alias("agreement"), F.avg("mean_logprob").alias("mean_logprob"),
        F.avg("repetition_rate").alias("repetition_rate"), F.avg("script_ratio").alias("script_ratio"),
        F.avg("elapsed_sec").alias("mean_elapsed_sec"))
    order = Window.orderBy(F.col("composite").desc(), "label")
    return scores.withColumn("position", F.row_number().over(order))
