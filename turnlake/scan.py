"""Running and neighbour columns over time-ordered rows, safe when one key is huge.

A window partitioned by ``session_id`` puts a whole session into one task. That is the
right plan while sessions are ordinary, and the wrong one when a single session holds a
large share of the table. ``Ordered`` offers both plans behind the same columns:

* plain: ``Window.partitionBy(key).orderBy(order)`` and nothing else;
* split: rows are range-partitioned on (key, order), each range is a block, the window
  runs per (key, block), and what earlier blocks contribute is added from a carry table.
  At most one key continues into each block, so the carry table has at most as many rows
  as there are blocks, and broadcasting it is bounded by that number.

Split mode reads its input twice, so it writes it to the shared folder first.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS_CONF = "turnlake.scan.maxRowsPerTask"
BLOCKS_CONF = "turnlake.scan.blocks"
DEFAULT_MAX_ROWS = 2_000_000

_BLOCK = "_block"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is the one in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="turnlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the table.

    Cuts the plan and the lineage: a lost executor costs a re-read, later steps see true
    sizes, and columns nobody uses are not read back. A table that several branches read is
    settled, not cached: the plan of a cached table stands whole in every plan that reads it,
    so over a few such steps plans double and double again, all of it on the driver.
    """
    path = new_folder(df.sparkSession, "turnlake")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def needs_split(df: DataFrame, key: Sequence[str]) -> bool:
    """Whether some key has more rows than one task should window over.

    One pre-aggregated count per key and a single row back; no data reaches the driver.
    """
    spark = df.sparkSession
    limit = int(spark.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))
    counts = df.groupBy(*key) if key else df.groupBy()
    largest = counts.count().agg(F.max("count")).first()[0]
    return (largest or 0) > limit


def _blocks(table: DataFrame) -> int:
    """How many blocks a written table is cut into: as many as hold the limit of rows each, so blocks
    do not grow with the table. The count comes from the files' footers."""
    spark = table.sparkSession
    fixed = spark.conf.get(BLOCKS_CONF, None)
    if fixed is not None:
        return int(fixed)
    limit = int(spark.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // limit))


@dataclass(frozen=True)
class Running:
    """One column to add: a fold over the rows before (or after) each row."""

    fold: str
    value: Column
    backward: bool = False
    inclusive: bool = False
    neighbour: bool = False

    def aggregate(self, value: Column) -> Column:
        if self.fold == "last":
            return F.last(value, ignorenulls=True)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.fold](value)

    def combine(self, carried: Column, local: Column) -> Column:
        if self.fold == "sum":
            return F.coalesce(carried + local, local, carried)
        if self.fold == "last":
            return F.coalesce(local, carried)
        return {"max": F.greatest, "min": F.least}[self.fold](carried, local)


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive=inclusive)


def running_max(value: Column, inclusive: bool = False) -> Running:
    return Running("max", value, inclusive=inclusive)


def following_min(value: Column, inclusive: bool = False) -> Running:
    return Running("min", value, backward=True, inclusive=inclusive)


def last_value(value: Column, inclusive: bool = False) -> Running:
    """The latest non-null value at (inclusive) or before the row."""
    return Running("last", value, inclusive=inclusive)


def previous(value: Column) -> Running:
    """The value one row back, null included."""
    return Running("last", F.struct(value.alias("v")), neighbour=True)


def following(value: Column) -> Running:
    """The value one row ahead, null included."""
    return Running("last", F.struct(value.alias("v")), backward=True, neighbour=True)


class Ordered:
    """Rows of each key in a total order. ``order`` must identify a row within its key."""

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str],
                 split: bool | None = None, _blocked: bool = False):
        self.key = list(key)
        self.order = list(order)
        self.split = needs_split(df, self.key) if split is None else split
        self._settled = False
        if self.split and not _blocked:
            df = settled(df)
            df = df.repartitionByRange(_blocks(df), *self.key, *self.order)
            df = settled(df.withColumn(_BLOCK, F.spark_partition_id()))
            self._settled = True
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_BLOCK)

    def _next(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.key, self.order, split=self.split, _blocked=True)

    def map(self, fn) -> "Ordered":
        """Apply a row-wise projection or filter without losing the blocks."""
        return self._next(fn(self._df))

    def _window(self, partition: list[str], run: Running):
        order = [F.col(c).desc() if run.backward else F.col(c).asc() for c in self.order]
        edge = Window.currentRow if run.inclusive else -1
        spec = Window.partitionBy(*partition).orderBy(*order)
        return spec.rowsBetween(Window.unboundedPreceding, edge)

    def with_columns(self, **runs: Running) -> "Ordered":
        if self.split:
            return self._next(self._with_carry(runs))
        rows = Window.partitionBy(*self.key).orderBy(*[F.col(c).asc() for c in self.order])

        def column(run: Running) -> Column:
            if run.neighbour:
                return (F.lead if run.backward else F.lag)(run.value).over(rows)["v"]
            return run.aggregate(run.value).over(self._window(self.key, run))

        return self._next(self._df.withColumns({name: column(run) for name, run in runs.items()}))

    def _with_carry(self, runs: dict[str, Running]) -> DataFrame:
        base = self._df if self._settled else settled(self._df)
        blocked = self.key + [_BLOCK]

        position = F.struct(*self.order)
        summary = base.groupBy(*blocked).agg(*[
            self._summary(run, position).alias(name) for name, run in runs.items()])
        carries = {}
        for name, run in runs.items():
            along = F.col(_BLOCK).desc() if run.backward else F.col(_BLOCK).asc()
            spec = Window.partitionBy(*self.key).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
            carries[f"_carry_{name}"] = run.aggregate(F.col(name)).over(spec)
        carry = summary.withColumns(carries).select(*blocked, *carries).dropna("all", subset=list(carries))

        df = base.join(F.broadcast(carry), blocked, "left").withColumns(
            {name: run.aggregate(run.value).over(self._window(blocked, run)) for name, run in runs.items()})

        def column(name: str, run: Running) -> Column:
            value = run.combine(F.col(f"_carry_{name}"), F.col(name))
            return value["v"] if run.neighbour else value

        return df.withColumns({name: column(name, run) for name, run in runs.items()}).drop(*carries)

    def _summary(self, run: Running, position: Column) -> Column:
        if run.fold != "last":
            return run.aggregate(run.value)
        pick = F.min_by if run.backward else F.max_by
        return pick(run.value, F.when(run.value.isNotNull(), position))
