"""Questions, answers and pauses, read from raw turns and transcript segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, QUESTION_WORDS, Thresholds
from turnlake.functions.text import is_question
from turnlake.ranges import in_buckets, overlap_join, BUCKET_SEC
from turnlake.scan import Ordered, following_min, running_max, running_sum

SESSION = ["session_id"]
#: Width, in the unit of the value, of the bins a median is counted in.
MEDIAN_BIN = 0.25


def first_owner(segments: DataFrame, marked: DataFrame, *carry: str) -> DataFrame:
    """The first teacher turn, in start order, overlapping each non-empty segment.

    Walking the turns and crossing off used segments gives every segment to exactly that
    turn, so a minimum per segment replaces the walk. The text itself stays behind.
    """
    spoken = segments.filter(F.col("text") != "").select(
        "session_id", "seg_ix", *carry, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    teacher = marked.filter("role = 'teacher'").select("session_id", "turn_ix", "start", "end", "run")
    pairs = overlap_join(spoken, teacher, SESSION, ("s_start", "s_end"), ("start", "end"))
    owner = pairs.groupBy("session_id", "seg_ix", "s_end", *carry).agg(
        F.min(F.struct("start", "turn_ix", "end", "run")).alias("o"))
    return owner.select("session_id", "seg_ix", *carry, "s_end", "o.turn_ix", "o.start", "o.end", "o.run")


def questions(segments: DataFrame, marked: DataFrame,
              lexicon: Sequence[str] = QUESTION_WORDS) -> DataFrame:
    """Teacher turns whose own segments read as a question.

    Lexicon words contain no space, so the joined text is a question exactly when one of the
    segments is; nothing needs collecting.
    """
    owned = first_owner(segments.withColumn("asks", is_question(F.col("text"), lexicon)), marked, "asks")
    return (owned.groupBy("session_id", "turn_ix", "start", "end", "run")
            .agg(F.bool_or("asks").alias("asks"), F.max("s_end").alias("span_end"))
            .filter("asks").drop("asks"))


def question_ends(asked: DataFrame, marked: DataFrame) -> DataFrame:
    """When the teacher stopped: the run of teacher turns from the question on, while the
    words of the question last. Candidates are only turns starting inside that time."""
    teacher = marked.filter("role = 'teacher'").select(
        F.col("session_id").alias("n_session"), F.col("run").alias("n_run"),
        F.floor(F.col("start") / BUCKET_SEC).alias("n_bucket"), F.col("turn_ix").alias("n_ix"),
        F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    follows = ((F.col("session_id") == F.col("n_session")) & (F.col("run") == F.col("n_run"))
               & (F.col("_bucket") == F.col("n_bucket")) & (F.col("n_start") < F.col("span_end"))
               & (F.struct("n_start", "n_ix") > F.struct("start", "turn_ix")))
    near = in_buckets(asked, "start", "span_end").join(teacher, follows, "left")
    ends = near.groupBy("session_id", "turn_ix", "start", "span_end", "end").agg(F.max("n_end").alias("later"))
    return ends.withColumn("q_end", F.greatest("end", "later")).drop("end", "later")


def answers(ended: DataFrame, marked: DataFrame, split: bool | None = None,
            t: Thresholds = DEFAULTS) -> DataFrame:
    """Whether and after what pause each question was answered.

    Questions and other speakers' turns go on one clock, questions first at equal times. The
    furthest end so far tells whether someone was already talking, the next start is the
    forward as-of match; both are running columns, so no pairs are formed.
    """
    asked = ended.select("session_id", F.col("q_end").alias("at"), F.lit(0).alias("kind"), "turn_ix",
                         F.lit(None).cast("double").alias("until"), "start", "span_end")
    others = marked.filter("role = 'student'").select(
        "session_id", F.col("start").alias("at"), F.lit(1).alias("kind"), "turn_ix",
        F.col("end").alias("until"), F.lit(None).cast("double").alias("start"),
        F.lit(None).cast("double").alias("span_end"))
    clock = Ordered(asked.unionByName(others), SESSION, ["at", "kind", "turn_ix"], split)
    clock = clock.with_columns(
        talking_until=running_max(F.col("until")),
        next_start=following_min(F.when(F.col("kind") == 1, F.col("at"))))
    q_end = F.col("at")
    already = F.coalesce(F.col("talking_until") > q_end, F.lit(False))
    gap = F.col("next_start") - q_end
    answered = already | F.coalesce(gap <= t.wait_max_sec, F.lit(False))
    wait = F.when(already, 0.0).when(answered & (gap > t.tie_sec), gap)
    return clock.df.filter(F.col("kind") == 0).select(
        "session_id", "turn_ix", "start", "span_end", q_end.alias("q_end"),
        already.alias("already_talking"), F.when(~already, gap).alias("gap"),
        answered.alias("answered"), wait.alias("wait"))


def discourse(marked: DataFrame, segments: DataFrame,
              lexicon: Sequence[str] = QUESTION_WORDS, split: bool | None = None,
              t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per question, with its answer and wait. ``marked`` comes from ``mark_roles``."""
    return answers(question_ends(questions(segments, marked, lexicon), marked), marked, split, t)


def pseudo_turns(labelled: DataFrame, split: bool | None = None) -> DataFrame:
    """Attributed speech rows as turns, for sessions without any: the roles are the speakers."""
    speech = labelled.filter((F.col("kind") == "speech") & F.col("role").isNotNull())
    student = F.when(F.col("role") == "student", 1).otherwise(0)
    return Ordered(speech, SESSION, ["start"], split).with_columns(
        turn_ix=running_sum(F.lit(1)), run=running_sum(student)).df.select(
        "session_id", F.col("turn_ix").cast("int").alias("turn_ix"), "start", "end",
        F.col("role").alias("speaker"), "role", "run")


def median_by_session(rows: DataFrame, value: str) -> DataFrame:
    """Exact median per session, by a histogram and the two bins that hold the middle.

    Equal values are counted first, then counts are summed over bins. The middle positions lie in one or
    two bins; only the values of these are ranked. Nothing is listed or sorted but bins and what is in one.
    """
    bins = F.floor(F.col("_value") / F.lit(MEDIAN_BIN))
    counted = rows.filter(F.col(value).isNotNull()).groupBy("session_id", F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n")).withColumn("_bin", bins)
    along = Window.partitionBy("session_id").orderBy("_bin")
    sums = counted.groupBy("session_id", "_bin").agg(F.sum("_n").alias("_in_bin")).withColumns({
        "_to": F.sum("_in_bin").over(along), "_all": F.sum("_in_bin").over(Window.partitionBy("session_id"))})
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    before = F.col("_to") - F.col("_in_bin")
    middle = sums.filter((F.col("_to") >= low) & (before < high)).select("session_id", "_bin", before.alias("_before"), low.alias("_low"), high.alias("_high"))
    within = Window.partitionBy("session_id", "_bin").orderBy("_value")
    ranked = counted.join(middle, ["session_id", "_bin"]).withColumn("_up", F.col("_before") + F.sum("_n").over(within))
    at = lambda position: F.min(F.when(F.col("_up") >= F.col(position), F.col("_value")))
    return ranked.groupBy("session_id").agg(((at("_low") + at("_high")) / 2).alias("median"))


def discourse_totals(asked: DataFrame) -> DataFrame:
    """Questions, responses, waits and the median wait per session."""
    counts = asked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("answered").alias("responses"), F.count("wait").alias("waits"))
    return counts.join(median_by_session(asked, "wait"), "session_id", "left")
