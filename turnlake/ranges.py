"""Overlap joins of two interval tables, partitioned by key and time bucket.

An equi join on the key alone compares every interval of a session with every other one
in a single task. Here each interval is copied to the fixed-width time buckets it touches
and the join key is (key, bucket), so a long or crowded session spreads over many tasks
and only near neighbours meet. A pair that shares several buckets is kept once: in the
bucket of the later of the two starts, which both intervals always touch.

Copies per table are its rows plus its total duration divided by the bucket width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_SEC = 60.0


def _bucket(seconds: Column, width: float) -> Column:
    return F.floor(seconds / F.lit(width))


def in_buckets(df: DataFrame, start: str, end: str, width: float = BUCKET_SEC,
               name: str = "_bucket") -> DataFrame:
    """One copy of each row for every time bucket that [start, end] touches."""
    first, last = _bucket(F.col(start), width), _bucket(F.col(end), width)
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 width: float = BUCKET_SEC, how: str = "inner") -> DataFrame:
    """Pairs with left.start < right.end and left.end > right.start.

    Column names of the two sides must differ except for ``on``. With ``how="left"`` a left
    row comes back without a partner at least once per bucket that holds none, so callers
    aggregate over the left row.
    """
    (ls, le), (rs, re) = left_span, right_span
    copies = in_buckets(right, rs, re, width, "_r_bucket").withColumnsRenamed({k: f"_r_{k}" for k in on})
    meets = ((F.col("_bucket") == F.col("_r_bucket")) & (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
             & (F.col("_bucket") == _bucket(F.greatest(ls, rs), width)))
    for k in on:
        meets = (F.col(k) == F.col(f"_r_{k}")) & meets
    pairs = in_buckets(left, ls, le, width).join(copies, meets, how)
    return pairs.drop("_bucket", "_r_bucket", *[f"_r_{k}" for k in on])
