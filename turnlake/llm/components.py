"""Connected components of a link table, by joins that shrink every tree each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import settled


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """``links`` (a, b: long) to (node, root), root being the smallest node reachable.

    Every round, each node's larger neighbours and then each node's smaller ones are tied to the
    smallest node it sees, until no link changes. Rounds grow with the logarithm of the longest
    path; if ``rounds`` do not do, the job stops rather than return a part. Only counts come back to the driver.
    Nodes without a link are not returned.
    """
    edges = settled(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.filter("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = settled(small.filter("u <> v").distinct(), "links")
        # A forest of stars is reached when the links stop changing.
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
