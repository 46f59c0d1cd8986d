"""A bounded sample of labelled documents, and the shared turning of texts into terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id, folds: int, fold: int):
    """Whether a document belongs to the fold that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``per_class`` documents of each class.

    The rows outside the held-out fold with the smallest hashes of their ids are taken, so runs agree.
    Only (doc_id, label) is sorted; the ids, at most twice ``per_class``, are what is broadcast.
    A doc_id with several labels counts with its greatest. Null ids and labels are left out.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).groupBy(
        "doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.filter("label = 1").orderBy(*order).limit(per_class).unionByName(
        rows.filter("label = 0").orderBy(*order).limit(per_class))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def shares(labels: DataFrame, label: str, folds: int, fold: int) -> float:
    """The share of label 1 among all rows outside the held-out fold (0.5 if there are none)."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    got = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if got is None else float(got)
