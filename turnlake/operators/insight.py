"""Rule-based text: headline, one suggestion, summary, and the message that carries them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, METRIC_KEYS, Thresholds
from turnlake.functions.numbers import duration_text, one_decimal_text, percent_text

# The published wording, which results must match.
HEADLINE_UNKNOWN = " of talking, but the recording could not tell your voice from the children's."
HEADLINE_HIGH = " — a hands-on session usually works better below "
HEADLINE_CLOSE = " — close to the target."
HEADLINE_CHILDREN = " — the children did most of the talking."
SUGGEST_BREAK = ". Try breaking it with a question at the halfway point."
SUGGEST_WAIT = (". Count to three before taking an answer — research finds responses get longer "
                "and more children join in.")
SUGGEST_GROUP = ("Try handing one explanation to a group to give back to the class — it moves talking "
                 "time to them without losing the content.")
SUGGEST_NAMED = ("Only a few children spoke. Try asking a question to a named group rather than the "
                 "whole room.")
SUGGEST_WATCH = " — about right, but worth watching if it grows."
SUGGEST_NOTHING = "Nothing stands out to change. Keep the phone where it is; the recording came through clearly."
ADVICE_NOISE = ("This recording was mostly room noise. Try keeping the phone on the front desk rather "
                "than in a pocket or bag.")
ADVICE_STOPPED = ("The recording stopped early — only part of the lesson was saved. Check the app is "
                  "still recording before you put the phone down.")
ADVICE_DEFAULT = "This recording was too noisy to read. Try keeping the phone closer to where you are standing."
UNRELIABLE_HEADLINE = " was too noisy to analyse reliably."
UNRELIABLE_SUMMARY = ("No metrics are shown for this recording. A number here would be a guess, and a "
                      "guess is worse than nothing.")
GREETING, BULB, ELLIPSIS = "नमस्ते", "💡", "…"


def _named(default: str) -> Column:
    return F.when(F.coalesce("activity", F.lit("")) == "", default).otherwise(F.col("activity"))


def headline(t: Thresholds = DEFAULTS) -> Column:
    what, ratio = _named("this session"), F.col("m1")
    opening = F.concat(F.lit("You spoke "), percent_text(ratio), F.lit(" of the talking time in "), what)
    spoken = F.col("teacher_sec") + F.col("student_sec")
    return (F.when(ratio.isNull(), F.concat(what, F.lit(": "), duration_text(spoken), F.lit(HEADLINE_UNKNOWN)))
            .when(ratio > t.talk_high, F.concat(
                opening, F.lit(HEADLINE_HIGH), percent_text(F.lit(t.talk_benchmark)), F.lit(".")))
            .when(ratio > t.talk_benchmark, F.concat(opening, F.lit(HEADLINE_CLOSE)))
            .otherwise(F.concat(opening, F.lit(HEADLINE_CHILDREN))))


def suggestion(t: Thresholds = DEFAULTS) -> Column:
    """The first rule that matches; a withheld metric is null and matches none."""
    stretch = F.concat(F.lit("Your longest unbroken stretch was "), duration_text(F.col("m4")))
    return (F.when(F.col("m4") > 300, F.concat(stretch, F.lit(SUGGEST_BREAK)))
            .when(F.col("m5") < t.wait_low_sec, F.concat(
                F.lit("After you asked a question you moved on in "), one_decimal_text(F.col("m5")),
                F.lit("s"), F.lit(SUGGEST_WAIT)))
            .when(F.col("m1") > t.talk_high, F.lit(SUGGEST_GROUP))
            .when(F.col("m2") < 1.0, F.lit(SUGGEST_NAMED))
            .when(F.col("m4") > 120, F.concat(stretch, F.lit(SUGGEST_WATCH)))
            .otherwise(F.lit(SUGGEST_NOTHING)))


def recording_advice() -> Column:
    return (F.when(F.col("conf_speech_density") < 0.4, ADVICE_NOISE)
            .when(F.col("conf_completeness") < 0.8, ADVICE_STOPPED).otherwise(ADVICE_DEFAULT))


def summary() -> Column:
    spoken = F.col("teacher_sec") + F.col("student_sec")
    bits = F.concat_ws(
        ", ",
        F.when(spoken > 0, F.concat(duration_text(spoken), F.lit(" of talking"))),
        F.when(F.col("handson_sec") > 0, F.concat(duration_text(F.col("handson_sec")), F.lit(" hands-on"))),
        F.when(F.col("dead_sec") > 30, F.concat(duration_text(F.col("dead_sec")), F.lit(" quiet"))),
        F.when(F.col("m3") > 0, F.concat(one_decimal_text(F.col("m3")), F.lit(" exchanges a minute"))))
    what = _named("This session")
    return F.when(bits != "", F.concat(what, F.lit(": "), bits, F.lit("."))).otherwise(
        F.concat(what, F.lit(": nothing measurable.")))


def insight(values: DataFrame, corpus: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per session; an unreliable verdict replaces everything else."""
    rows = values.join(corpus.select("session_id", "activity", "alias"), "session_id")
    poor = F.col("verdict") == "unreliable"
    numbers = (1, 2, 3, 4, 5, 7, 8)
    shown = F.filter(F.array(*[F.when(F.col(f"m{n}").isNotNull(), F.lit(k))
                               for n, k in zip(numbers, METRIC_KEYS)]), lambda k: k.isNotNull())
    none = F.array().cast("array<string>")
    return rows.select(
        "session_id", "alias", "verdict",
        F.when(poor, F.concat(_named("This session"), F.lit(UNRELIABLE_HEADLINE))).otherwise(headline(t)).alias("headline"),
        F.when(poor, recording_advice()).otherwise(suggestion(t)).alias("suggestion"),
        F.when(poor, F.lit(UNRELIABLE_SUMMARY)).otherwise(summary()).alias("summary"),
        F.when(poor, none).otherwise(shown).alias("metrics_shown"),
        F.lit("rules-v1").alias("generated_by"))


def message(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Greeting, headline and suggestion, cut to the message limit."""
    named = F.coalesce("alias", F.lit("")) != ""
    greeting = F.when(named, F.concat(F.lit(GREETING + " "), F.col("alias"), F.lit("!"))).otherwise(F.lit(GREETING + "!"))
    body = F.concat(greeting, F.lit("\n\n"), F.col("headline"), F.lit("\n\n" + BULB + " "), F.col("suggestion"))
    limit = t.message_max_chars
    cut = F.concat(F.regexp_replace(F.substring(body, 1, limit - 1), r"(?U)\s+$", ""), F.lit(ELLIPSIS))
    return rows.withColumn("message", F.when(F.length(body) > limit, cut).otherwise(body))
