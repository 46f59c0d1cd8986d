"""Session-level projections: flags, roster checks, pseudonyms, the public shape, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, LANGUAGE_CODES, Thresholds
from turnlake.functions.numbers import round_even
from turnlake.functions.text import strip
from turnlake.operators.metrics import completeness
from turnlake.scan import Ordered, running_sum


def parse_timestamp(text: Column) -> Column:
    """Two accepted layouts, tried in turn, digits with or without a zero before; anything else is null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s")),
                      F.try_to_timestamp(text, F.lit("yyyy-M-d'T'H:m:s")))


def roster_consistent() -> Column:
    return F.col("roster.boys") + F.col("roster.girls") == F.col("roster.total")


def checked_roster(sessions: DataFrame) -> DataFrame:
    """Stops the job on a negative head count."""
    low = F.least("roster.total", "roster.boys", "roster.girls")
    return sessions.withColumn("roster", F.when(low >= 0, F.col("roster")).otherwise(F.raise_error(
        F.lit("roster counts cannot be negative")).cast(sessions.schema["roster"].dataType)))


def has_gps() -> Column:
    return F.col("photo.latitude").isNotNull() & F.col("photo.longitude").isNotNull()


def quality_flags(t: Thresholds = DEFAULTS) -> Column:
    """Ordered array of capture problems."""
    share = completeness(F.col("actual_sec"), F.col("declared_sec"))
    flags = F.array(F.when(share < t.completeness_ok, F.lit("audio_truncated")),
                    F.when(~roster_consistent(), F.lit("roster_mismatch")),
                    F.when(~has_gps(), F.lit("no_gps")))
    return F.filter(flags, lambda f: f.isNotNull())


def capture_notes(flags: Column, share: Column) -> Column:
    """Readable note per flag, truncation first, then GPS, then head count."""
    # The published wording.
    truncated = F.concat(F.lit("Recording is truncated — only "), F.floor(share * 100 + 0.5).cast("string"),
                         F.lit("% of the declared duration was saved."))
    notes = F.array(
        F.when(F.array_contains(flags, "audio_truncated") & share.isNotNull(), truncated),
        F.when(F.array_contains(flags, "no_gps"), F.lit("No GPS recorded for this session.")),
        F.when(F.array_contains(flags, "roster_mismatch"),
               F.lit("Headcount does not add up: boys + girls ≠ total.")))
    return F.filter(notes, lambda n: n.isNotNull())


def _letters(position: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: bijective base 26."""
    start = F.struct(position.cast("bigint").alias("n"), F.lit("").alias("s"))

    def step(acc, _):
        digit = F.pmod(acc["n"] - 1, F.lit(26).cast("bigint"))
        more = F.struct(F.floor((acc["n"] - 1 - digit) / 26).alias("n"),
                        F.concat(F.char(digit + 65), acc["s"]).alias("s"))
        return F.when(acc["n"] > 0, more).otherwise(acc)

    # 14 letters cover every bigint.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["s"]


def aliases(sessions: DataFrame, split: bool | None = None) -> DataFrame:
    """A stable pseudonym per teacher id, by sorted id over the whole corpus."""
    ids = sessions.select("teacher_id").filter(F.coalesce("teacher_id", F.lit("")) != "").distinct()
    ranked = Ordered(ids, [], ["teacher_id"], split).with_columns(_n=running_sum(F.lit(1))).df
    return ranked.select("teacher_id", F.concat(F.lit("Teacher "), _letters(F.col("_n"))).alias("alias"))


def with_alias(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach aliases; no id is 'Teacher ?', an id missing from the registry stops the job."""
    known = F.coalesce("teacher_id", F.lit("")) != ""
    unknown = F.raise_error(F.concat(F.lit("unknown teacher id: "), F.col("teacher_id")))
    return sessions.join(registry, "teacher_id", "left").withColumn(
        "alias", F.when(~known, F.lit("Teacher ?")).when(F.col("alias").isNull(), unknown)
        .otherwise(F.col("alias")))


def build_corpus(sessions: DataFrame, recordings: DataFrame, split: bool | None = None) -> DataFrame:
    """Metadata, measured audio and alias for every session that has both tables' rows."""
    both = sessions.join(recordings, "session_id")
    return with_alias(both, aliases(both, split))


def public_projection(corpus: DataFrame) -> DataFrame:
    """The only columns that may be published: no name, no address, no device path."""
    share = completeness(F.col("actual_sec"), F.col("declared_sec"))
    return corpus.select(
        "session_id", "teacher_id", "alias", "activity",
        F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("recorded_at"),
        F.col("roster.total").alias("roster_total"), F.col("roster.boys").alias("roster_boys"),
        F.col("roster.girls").alias("roster_girls"),
        F.when(F.col("declared_sec") != 0, round_even(F.col("declared_sec"), 1)).alias("declared_sec"),
        round_even(F.col("actual_sec"), 1).alias("actual_sec"),
        round_even(share, 3).alias("completeness"), "sample_rate", "channels",
        has_gps().alias("has_gps"), quality_flags().alias("flags"))


def language_code(raw: Column) -> Column:
    """Language name to ISO code; an unknown name stays, an empty one is 'unknown'."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    name = F.lower(F.coalesce(raw, F.lit("")))
    return F.coalesce(F.try_element_at(table, name), F.when(name != "", name), F.lit("unknown"))


def valid_segments(segments: DataFrame) -> DataFrame:
    """Strip text; a segment that ends before it starts stops the job."""
    bad = F.raise_error(F.lit("segment ends before it starts")).cast("double")
    return segments.withColumn("end", F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(bad)
                               ).withColumn("text", strip(F.col("text")))


def first_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The first n sessions by id."""
    return sessions.orderBy("session_id").limit(n)


def corpus_totals(corpus: DataFrame) -> DataFrame:
    """Declared and measured minutes, and the share lost of what was declared."""
    declared = F.sum(F.coalesce("declared_sec", "actual_sec"))
    measured = F.sum("actual_sec")
    return corpus.agg((declared / 60.0).alias("declared_min"), (measured / 60.0).alias("measured_min"),
                      F.when(declared > 0, 1.0 - measured / declared).alias("lost_share"))
