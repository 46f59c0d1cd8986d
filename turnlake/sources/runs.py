"""Runs that count once they are finished.

A run writes its tables to folders of its own and is then listed: one small row under ``finished``. Readers
take listed runs only, so a run that stopped between two tables is as if it had not begun, and may be
written again under its name.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "base boolean, run string"


def new_run() -> str:
    """Name of a run; later runs sort later. The letter keeps it text when folders are read."""
    return f"r{time.time_ns():020d}"


def read_or_empty(read, spark: SparkSession, columns: str) -> DataFrame:
    """What ``read()`` gives; a folder that was never written is an empty table."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed run: run, and whether it is a base that holds all that earlier runs held."""
    return read_or_empty(lambda: spark.read.schema(LISTED).json(f"{path}/finished"), spark, LISTED)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The runs to read: the latest base and those after it, or all without a base."""
    runs = finished(spark, path)
    base = runs.agg(F.max(F.when(F.col("base"), F.col("run"))).alias("_base"))
    return runs.join(F.broadcast(base), F.col("_base").isNull() | (F.col("run") >= F.col("_base"))).select("run")


def begin(spark: SparkSession, path: str, run: str) -> None:
    """Refuse to write a finished run anew."""
    if not finished(spark, path).filter(F.col("run") == run).isEmpty():
        raise ValueError(f"run {run} is finished")


def finish(spark: SparkSession, path: str, run: str, base: bool = False) -> None:
    """List a run whose tables are all written."""
    spark.range(1).select(F.lit(base).alias("base")).write.mode("overwrite").json(f"{path}/finished/run={run}")
