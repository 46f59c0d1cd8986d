"""Exact top-k search by inner product, reading sorted lists only.

Every dimension of a block of candidates is a list sorted by value. For a query the list is read from
its better end: from the top where the query's component is positive, else from the bottom. After
each step of reading, what was seen of a candidate gives bounds of its score: unseen components count as the
list's last value (lower bound) or as the value where reading stands (upper bound). A candidate whose
upper bound lies below the k-th best lower bound is out, and so are all that were never seen once the
reading fronts alone stay below it. When at most ``finalists`` candidates per query are left, or the
lists are read, the scores of those left are resolved.

Reading goes a share of each list at a time, for a block of queries together: whether an entry has been
read is a matter of its rank, so the sums over the entries read are matrix products. Candidates and
queries are dealt to (candidate block, query block) pairs; a task keeps k results a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import settled

#: Shares of each list read, one after another; close together where vectors without structure are settled.
DEPTHS = (0.5, 0.8, 0.9, 0.95, 1.0)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int,
                  finalists: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of a block for each query; ties to the smaller vec_id.

    Whole numbers are held as float64; products stay far below 2^53.
    """
    order = np.argsort(ids, kind="stable")
    block, ids = block[order], ids[order]
    n, dims = block.shape
    rank = np.empty((n, dims), np.int64)  # from the smallest value up
    by_value = np.argsort(block, axis=0, kind="stable")
    np.put_along_axis(rank, by_value, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(block, by_value, axis=0)
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    least = positive @ ordered[0] + negative @ ordered[-1]
    own = query_ids[:, None] == ids[None, :]
    top = min(k, n)
    live = np.arange(len(queries))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def resolve(rows: np.ndarray, open_pairs: np.ndarray) -> None:
        """Final scores of the pairs left; open_pairs: (rows, candidates)."""
        where_row, where = np.nonzero(open_pairs)
        width = int(open_pairs.sum(axis=1).max()) if len(where) else 0
        if not width:
            return
        at = np.arange(len(where_row)) - np.searchsorted(where_row, where_row)
        score = np.full((len(rows), width), -np.inf)
        score[where_row, at] = np.einsum("ij,ij->i", queries[rows[where_row]], block[where]) if len(where) < 4_000_000 // dims \
            else np.concatenate([np.einsum("ij,ij->i", queries[rows[r]], block[c]) for r, c in zip(
                np.array_split(where_row, 1 + len(where) * dims // 4_000_000), np.array_split(where, 1 + len(where) * dims // 4_000_000))])
        which = np.zeros((len(rows), width), np.int64)
        which[where_row, at] = where
        first = np.argsort(-score, axis=1, kind="stable")[:, :top]  # ids are in order, so ties go to the smaller
        got = np.take_along_axis(score, first, axis=1)
        real = np.isfinite(got)
        row = np.repeat(np.arange(len(rows)), real.sum(axis=1))
        out.append((rows[row], ids[np.take_along_axis(which, first, axis=1)[real]], got[real].astype(np.int64)))

    for depth in DEPTHS:
        if not len(live):
            break
        read = max(1, int(np.ceil(n * depth)))
        if read >= n:
            # Everything has been read, so lower and upper bounds are the scores.
            score = queries[live] @ block.T
            score[own[live]] = -np.inf
            bar = np.partition(score, n - top, axis=1)[:, n - top]
            resolve(live, (score >= bar[:, None]) & np.isfinite(score))
            break
        from_top, from_bottom = rank >= n - read, rank < read
        q_up, q_down = positive[live], negative[live]
        front = np.concatenate((q_up * ordered[n - read], q_down * ordered[read - 1]), axis=1)
        # What a read entry adds over the worst value of its list, and over the reading front.
        over_least = np.concatenate(((block - ordered[0]) * from_top, (block - ordered[-1]) * from_bottom), axis=1)
        q = np.concatenate((q_up, q_down), axis=1)
        lower = q @ over_least.T + least[live][:, None]
        over_front = np.concatenate(((block - ordered[n - read]) * from_top, (block - ordered[read - 1]) * from_bottom), axis=1)
        upper = q @ over_front.T + front.sum(axis=1)[:, None]
        lower[own[live]] = -np.inf
        bar = np.partition(lower, n - top, axis=1)[:, n - top]
        # Never seen: the upper bound of such a candidate is the sum of the fronts, which `upper` is for it.
        left = (upper >= bar[:, None]) & ~own[live]
        done = left.sum(axis=1) <= max(finalists, top)
        resolve(live[done], left[done])
        live = live[~done]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and its components times ``scale``, rounded down; unusable vectors are left out."""
    value = F.col("embedding")
    fine = value.isNotNull() & F.col("vec_id").isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").filter(fine).select(
        "vec_id", F.transform(value, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best of all other rows, for each row whose id ``every`` divides.

    ``vectors`` needs vec_id and embedding (array of float or double); other columns are ignored. A vector
    that is null, holds a null or a non-finite component, or has no id takes no part. Vectors of
    different lengths meet only those of their own length. Rows that repeat a vec_id and its components are
    one; rows that repeat a vec_id with other components are candidates of their own for other ids, and
    the query is the one with the greatest components. Fewer than k others give fewer rows.
    """
    rows = settled(whole_numbers(vectors, scale).distinct().withColumn("dims", F.size("v")), "vectors")
    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("dims", F.size("v"))
    # The only numbers that come back to the driver are the counts that set the number of blocks.
    n, n_asked = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_asked // query_rows))
    spread = lambda i: F.explode(F.sequence(F.lit(0), F.lit(i - 1)))
    home = lambda i, seed: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(seed)), F.lit(i)).cast("int")
    left = asked.select("vec_id", "v", "dims", home(query_blocks, 1).alias("q"), spread(blocks).alias("b"))
    right = rows.select("vec_id", "v", "dims", spread(query_blocks).alias("q"), home(blocks, 2).alias("b"))

    def best(_, a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not a.num_rows or not b.num_rows:
            return empty
        dims = a.column("dims")[0].as_py()
        if not dims:
            matrix = lambda t: np.zeros((t.num_rows, 1))
        else:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        names = a.column("vec_id").to_numpy()
        row, found, score = best_of_block(matrix(a), names, matrix(b), b.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": names[row], "vec_id": found, "score": score})

    near = left.groupBy("q", "b", "dims").cogroup(right.groupBy("q", "b", "dims")).applyInArrow(best, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SEARCH_SQL = """with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from pairs qualify rank <= 5"""
