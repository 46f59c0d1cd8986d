"""Hand-labelling samples, their truth, and how well predictions match it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.config import DEFAULTS, Thresholds
from turnlake.operators.intervals import numbered, text_of_spans

ROLES = ("teacher", "student")


def sample_rows(labelled: DataFrame, segments: DataFrame, split: bool | None = None) -> DataFrame:
    """One row per attributed speech piece, named by its position in the whole timeline."""
    rows = numbered(labelled, split).filter((F.col("kind") == "speech") & F.col("role").isNotNull())
    text = text_of_spans(rows, segments, ["seg_no"])
    name = F.concat(F.col("session_id").cast("string"), F.lit("#"),
                    F.lpad(F.col("seg_no").cast("string"), 4, "0"))
    padded = F.when(F.col("seg_no") > 9999, F.concat(
        F.col("session_id").cast("string"), F.lit("#"), F.col("seg_no").cast("string"))).otherwise(name)
    return rows.join(text, ["session_id", "seg_no"], "left").select(
        padded.alias("row_id"), "session_id", "start", "end", F.col("role").alias("predicted"),
        F.coalesce("role_conf", F.lit(0.0)).alias("confidence"),
        F.coalesce("text", F.lit("")).alias("text"))


def with_truth(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach hand labels by row id; rows without one stay unlabelled."""
    return rows.join(truth.select("row_id", "truth"), "row_id", "left")


def _labelled() -> Column:
    return F.col("truth").isNotNull()


def _scores(t: Thresholds) -> list[Column]:
    right = _labelled() & (F.col("predicted") == F.col("truth"))
    sure = _labelled() & (F.col("confidence") >= t.role_conf_floor)
    ratio = lambda a, b: F.when(b > 0, a / b)
    recall = [ratio(F.count_if(right & (F.col("truth") == r)), F.count_if(F.col("truth") == r))
              .alias(f"recall_{r}") for r in ROLES]
    return [F.count(F.lit(1)).alias("total"), F.count_if(_labelled()).alias("labelled"),
            F.count_if(right).alias("correct"),
            ratio(F.count_if(right), F.count_if(_labelled())).alias("accuracy"),
            ratio(F.count_if(right & sure), F.count_if(sure)).alias("confident_accuracy"), *recall]


def score_labels(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Accuracy over labelled rows; an unlabelled row is never a correct one."""
    return rows.agg(*_scores(t))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.filter(_labelled()).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def score_by_sheet(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The same scores per sheet, and over all of them in a row marked ``is_total``."""
    return rows.rollup("sheet").agg((F.grouping("sheet") == 1).alias("is_total"), *_scores(t))
