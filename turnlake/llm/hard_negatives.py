"""Hard negatives by segment summaries.

Vectors are cut into segments, and of each segment only its mean and deviation are looked at: the inner
product of two segments of length L is L times the product of the means, plus or minus at most L times the
product of the deviations. Summed over segments this bounds a score from both sides. Pairs whose
bounds miss what is still wanted are out; for the others the segments are refined: every one is halved until
they hold two components, then those with the largest deviations are cut to single components, whose
deviation is nothing. Pairs left over are scored exactly.

What is wanted moves up as exact scores come in: candidates of a block are met in slices, longest vectors first, and
an upper bound has to reach the k-th best score found so far.

Two rounds use this: the best rows of the anchor's own label, and below each of their scores the best
rows of other labels. Anchors and candidates are dealt to (candidate block, anchor block) pairs; a task
returns k rows for each thing asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import settled

#: Candidates met at a time within a block.
SLICE = 512
#: Pairs are scored one by one where at most this share of a slice is left, else as a matrix product.
SPARSE = 0.05


def segmentations(weight: np.ndarray) -> list[np.ndarray]:
    """Segment starts from coarse to fine; ``weight`` says which pairs of components are cut first (largest)."""
    d = len(weight)
    ends, out = [0, d], []
    while True:
        out.append(np.array(ends[:-1]))
        if max(b - a for a, b in zip(ends, ends[1:])) <= 2:
            break
        ends = sorted({*ends, *((a + b) // 2 for a, b in zip(ends, ends[1:]) if b - a > 2)})
    pairs = [(a, b) for a, b in zip(ends, ends[1:]) if b - a == 2]
    pairs.sort(key=lambda p: -(weight[p[0]] + weight[p[0] + 1]))
    while len(pairs) > 1:
        half = len(pairs) // 2
        ends, pairs = sorted({*ends, *(a + 1 for a, _ in pairs[:half])}), pairs[half:]
        out.append(np.array(ends[:-1]))
    return out


def summary(vectors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment, both times the square root of its length."""
    d = vectors.shape[1]
    length = np.diff(np.append(starts, d))
    total = np.add.reduceat(vectors, starts, axis=1)
    mean = total / length
    away = vectors - np.repeat(mean, length, axis=1)
    spread = np.sqrt(np.add.reduceat(away * away, starts, axis=1))
    return mean * np.sqrt(length), spread


class Best:
    """The k best (score, then smaller id) of each row asked, within its floor and ceiling."""

    def __init__(self, floors: np.ndarray, ceilings: np.ndarray, k: int):
        self.floors, self.ceilings, self.k = floors, ceilings, k
        self.row = self.ids = self.score = np.zeros(0, np.int64)
        #: Score that a new one has to reach.
        self.bar = floors.astype(np.float64)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        fine = (score >= self.bar[row]) & (score <= self.ceilings[row])
        if not fine.any():
            return
        row, ids, score = (np.concatenate((old, new[fine])) for old, new in ((self.row, row), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.k
        self.row, self.ids, self.score = row[first], ids[first], score[first]
        full = place[first] == self.k - 1
        self.bar[self.row[full]] = self.score[full]


def search_block(anchors: np.ndarray, anchor_ids: np.ndarray, asked_of: np.ndarray, floors: np.ndarray, ceilings: np.ndarray,
                 block: np.ndarray, ids: np.ndarray, k: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row asked, id, score) of the k best of ``block`` for each row asked.

    Row r asks on behalf of anchor ``asked_of[r]`` for scores in [floors[r], ceilings[r]]. An anchor's own id is no
    candidate. Scores are whole numbers below 2^53. ``seen`` counts pairs and those that reached exact scoring.
    """
    if not len(ids) or not len(asked_of):
        none = np.zeros(0, np.int64)
        return none, none, none
    best = Best(floors, ceilings, k)
    order = np.lexsort((ids, -(block * block).sum(axis=1)))
    block, ids = block[order], ids[order]
    cuts = segmentations(anchors.std(axis=0) * block.std(axis=0))
    of_anchors = [summary(anchors, c) for c in cuts]
    size = np.sqrt((anchors * anchors).sum(axis=1))
    highest = np.full(len(anchors), -np.inf)
    np.maximum.at(highest, asked_of, ceilings)
    by_anchor = np.argsort(asked_of, kind="stable")
    starts = np.searchsorted(asked_of[by_anchor], np.arange(len(anchors) + 1))
    for at in range(0, len(ids), SLICE):
        part, names = block[at:at + SLICE], ids[at:at + SLICE]
        lowest = np.full(len(anchors), np.inf)
        np.minimum.at(lowest, asked_of, best.bar)
        first_bar = np.full(len(anchors), -np.inf)
        # Rounding of sums of squares and products stays far below this.
        slack = 1e-9 * size * np.sqrt((part * part).sum(axis=1).max()) + 1e-6
        live = anchor_ids[:, None] != names[None, :]
        rows = np.nonzero(live.any(axis=1))[0]
        for starts_of, (mean, spread) in zip(cuts, of_anchors):
            part_mean, part_spread = summary(part, starts_of)
            wide = (part_spread > 0).any(axis=0)
            middle, reach = mean[rows] @ part_mean.T, spread[rows][:, wide] @ part_spread[:, wide].T
            reach += slack[rows][:, None]
            # Nothing found yet and nothing too high: the k-th best lower bound is a floor as well.
            new = np.isinf(lowest[rows]) & np.isinf(highest[rows])
            if new.any() and len(names) > k:
                lower = np.where(live[rows[new]], middle[new] - reach[new], -np.inf)
                first_bar[rows[new]] = np.maximum(first_bar[rows[new]], np.partition(lower, len(names) - k, axis=1)[:, len(names) - k])
            live[rows] &= (middle + reach >= np.maximum(lowest, first_bar)[rows][:, None]) & (middle - reach <= highest[rows][:, None])
            rows = rows[live[rows].any(axis=1)]
            if live[rows].sum() <= SPARSE * live.size:
                break
        row, where = np.nonzero(live)
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + live.size
            seen["scored"] = seen.get("scored", 0) + len(row)
        if len(row) > SPARSE * live.size:
            score = (anchors @ part.T)[row, where]
        else:
            score = np.einsum("ij,ij->i", anchors[row], part[where])
        score = score.astype(np.int64)
        # Every row that asks for this anchor meets the pair.
        times = (starts[1:] - starts[:-1])[row]
        pair = np.repeat(np.arange(len(row)), times)
        step = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        best.add(by_anchor[starts[row[pair]] + step], names[where[pair]], score[pair])
    return best.row, best.ids, best.score


def usable(vectors: DataFrame, scale: int, shift_every: int, labels: int) -> DataFrame:
    """vec_id, label and whole-number components of the rows that take part, one row for equal ones."""
    value = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.when(F.pmod(F.col("vec_id"), F.lit(shift_every)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", "label").filter(fine).select(
        "vec_id", label.cast("long").alias("label"), F.transform(value, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    ).distinct().withColumn("dims", F.size("v"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    n = len(column)
    if not dims:
        return np.zeros((n, 1))
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(n, dims)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def mined(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256, least_percent: int = 80,
          shift_every: int = 7, labels: int = 10, block_rows: int = 4096, anchor_rows: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. Positives are an anchor's best other rows of its label; for each, the
    best rows of other labels scoring at most as much and at least ``least_percent`` of it. Rows whose id ``shift_every``
    divides first move on to the next of ``labels`` labels.

    ``vectors`` needs vec_id, embedding (array of float or double) and label; other columns are ignored. A row with a
    null id, label or vector, or with a null or non-finite component, takes no part. Vectors of different lengths never meet; empty vectors
    score 0. Ties go to the smaller id. Repeated rows are one; rows that repeat an id with another vector or label are
    candidates of their own for other anchors, and the anchor is the greatest by (components, label). Anchors without positives, and
    positives without negatives, give no row; an empty table gives none. Scores must stay below 2^53.
    """
    rows = settled(usable(vectors, scale, shift_every, labels), "labelled-vectors")
    anchors = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).groupBy("vec_id").agg(
        F.max(F.struct("v", "label")).alias("a")).select(F.col("vec_id").alias("vec_id"), "a.v", "a.label", F.size("a.v").alias("dims"))
    # The only numbers that come back to the driver are the counts that set the number of blocks.
    n, n_anchors = rows.count(), anchors.count()
    blocks, anchor_blocks = max(1, -(-n // block_rows)), max(1, -(-n_anchors // anchor_rows))
    spread = lambda i: F.explode(F.sequence(F.lit(0), F.lit(i - 1)))
    home = lambda i, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(i)).cast("int")
    left = lambda df: df.select("*", home(anchor_blocks, 1).alias("q")).select("*", spread(blocks).alias("b"))
    right = rows.select("*", spread(anchor_blocks).alias("q"), home(blocks, 2).alias("b"))

    def own_label(_, a: pa.Table, b: pa.Table) -> pa.Table:
        ask = np.arange(a.num_rows)
        dims = a.column("dims")[0].as_py() if a.num_rows else 0
        ids = _numbers(a, "vec_id")
        row, found, score = search_block(_matrix(a.column("v"), dims), ids, ask, np.full(len(ask), -np.inf), np.full(len(ask), np.inf),
                                         _matrix(b.column("v"), dims), _numbers(b, "vec_id"), positives) if a.num_rows and b.num_rows else (ask[:0],) * 3
        return pa.table({"anchor_id": pa.array(ids[row], pa.int64()), "positive_id": pa.array(found, pa.int64()), "positive_score": pa.array(score, pa.int64())})

    def ranked(by: list[str], score: str, name: str) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), name))

    keys = ("q", "b", "dims", "label")
    near = left(anchors).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(own_label, "anchor_id long, positive_id long, positive_score long")
    chosen = settled(near.withColumn("_n", ranked(["anchor_id"], "positive_score", "positive_id")).filter(F.col("_n") <= positives).drop("_n"), "positives")

    # At most ``positives`` numbers an anchor.
    asked = anchors.join(chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores")), "vec_id")

    def other_labels(_, a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            dims = a.column("dims")[0].as_py()
            names, of = _numbers(a, "vec_id"), _numbers(a, "label")
            block, block_ids, block_labels = _matrix(b.column("v"), dims), _numbers(b, "vec_id"), _numbers(b, "label")
            vectors_of, scores = _matrix(a.column("v"), dims), a.column("scores").combine_chunks()
            sizes = np.diff(scores.offsets.to_numpy())
            top = scores.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(a.num_rows), sizes)
            for label in np.unique(of):
                mine, others = np.nonzero(of == label)[0], block_labels != label
                take = np.isin(owner, mine)
                row, found, score = search_block(
                    vectors_of[mine], names[mine], np.searchsorted(mine, owner[take]), -(-least_percent * top[take] // 100).astype(np.float64),
                    top[take].astype(np.float64), block[others], block_ids[others], negatives)
                parts.append((names[owner[take]][row], top[take][row], found, score))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("anchor_id", "positive_score", "negative_id", "negative_score"), columns)})

    keys = ("q", "b", "dims")
    far = left(asked).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        other_labels, "anchor_id long, positive_score long, negative_id long, negative_score long")
    best = far.withColumn("rank", ranked(["anchor_id", "positive_score"], "negative_score", "negative_id")).filter(F.col("rank") <= negatives)
    return chosen.join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


MINED_SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id and len(a.v) = len(c.v)),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives p join pairs n on p.anchor_id = n.anchor_id and not same
  and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5"""
