"""Running again over a corpus that has changed in part.

A store keeps entries by run and by bucket, the first two digits of their key's digest, with a flag that says whether an
entry can be read. What is asked for reads the buckets of its own keys, by key and flag, and parses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.sources import runs
from turnlake.sources.documents import is_readable

ENTRY = "key string, value string, readable boolean, run string, bucket string"


def _bucket() -> Column:
    """One of 256."""
    return F.substring(F.sha2("key", 256), 1, 2)


def entries(spark: SparkSession, store: str) -> DataFrame:
    """What a store holds of finished runs: key, value (JSON text), readable, run, bucket. A new store is empty."""
    rows = runs.read_or_empty(lambda: spark.read.schema(ENTRY).parquet(f"{store}/entries"), spark, ENTRY)
    return rows.join(F.broadcast(runs.current(spark, store)), "run", "left_semi")


def _write(rows: DataFrame, store: str, run: str, base: bool = False) -> None:
    """Rows (key, value) as a finished run, each marked once with whether it can be read."""
    spark = rows.sparkSession
    runs.begin(spark, store, run)
    rows.select("key", "value", is_readable(F.col("value")).alias("readable"), _bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/entries/run={run}")
    runs.finish(spark, store, run, base)


def _latest(held: DataFrame) -> DataFrame:
    """Of several readable entries for a key the latest run's."""
    return held.filter("readable").groupBy("bucket", "key").agg(F.max(F.struct("run", "value")).alias("e")).select("bucket", "key", "e.value", "e.run")


def run_pending(work: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame], run: str) -> DataFrame:
    """Compute what the store has no readable entry for, add it as a run, and return the entries of ``work``.

    ``work`` has key and whatever ``compute`` needs to turn rows into (key, value). Equal content has equal
    keys and is computed once. Entries made before stay as they are; of several readable ones for a
    key the latest run's counts. A run that stops half way counts for nothing and can be made again.
    """
    spark = work.sparkSession
    asked = work.withColumn("bucket", _bucket())
    # At most 256 names; with them the planner lists only these folders.
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    held = entries(spark, store).filter(F.col("bucket").isin(buckets) & F.col("readable")).select("bucket", "key").distinct()
    todo = asked.join(held, ["bucket", "key"], "left_anti").drop("bucket").dropDuplicates(["key"])
    _write(compute(todo).select("key", "value"), store, run)
    found = _latest(entries(spark, store).filter(F.col("bucket").isin(buckets)))
    return asked.join(found, ["bucket", "key"]).drop("bucket")


def compact(spark: SparkSession, store: str, run: str) -> None:
    """One readable entry per key as a new base; what earlier runs hold is not read any more. Their folders stay
    until the store's owner removes them."""
    _write(_latest(entries(spark, store)).select("key", "value"), store, run, base=True)
