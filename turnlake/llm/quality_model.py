"""Quality by naive Bayes support vectors.

A text is the set of its n-grams: words, and runs of up to three word shapes (letter case, length,
punctuation, whether a word repeats the one before). An n-gram's weight is the logarithm of how much more
of the good than of the poor labelled documents hold it. Texts become vectors of these weights, scaled to
length one, and a linear hinge-loss model is fitted to them by dual coordinate descent. Its
margin becomes a probability by a logistic curve fitted on labelled rows that the model has not seen.

N-grams are hashed to 2^18 columns; counts per column are summed by Spark. The model is fitted on a
sample of at most twice ``per_class`` labelled documents, which bounds the fit whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm import labelled
from turnlake.llm import windows as w
from turnlake.llm.common import runs_of_rows, settled, text_bytes

U = np.uint64
COLUMN_BITS = 18
COLUMNS = 1 << COLUMN_BITS


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the labelled sample; ``cost`` is the weight of the hinge loss."""

    folds: int = 5
    fold: int = 0
    per_class: int = 4000
    cost: float = 1.0
    rounds: int = 20
    smoothing: float = 1.0
    threshold: float = 0.3


# ---------------------------------------------------------------------------------------------- n-grams
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes: 0 other, 1 lower-case letter or part of a longer character, 2 capital, 3 digit, 4 stop, 5 symbol.
_KIND = np.zeros(256, np.int64)
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
for _c in b".,;:!?'\"":
    _KIND[_c] = 4
for _c in b"#*$%&|<>{}[]()/\\=+_~^@`-":
    _KIND[_c] = 5
_ONE = np.array([np.where(_KIND == k, 1, 0) for k in range(6)], dtype=np.int64)


def _shapes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A small number for each word: which kinds of bytes it has, how it begins and ends, its length, repetition."""
    size = ends - begins
    some = np.zeros(len(begins), np.int64)
    for kind in range(1, 6):
        running = np.concatenate(([0], np.cumsum(_ONE[kind][data])))
        n = running[ends] - running[begins]
        some += np.where(n == 0, 0, np.where(n == size, 2, 1)) * 3 ** (kind - 1)
    again = np.zeros(len(begins), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    long = np.searchsorted([3, 7, 14, 30], size)
    return (((some * 6 + _KIND[data[begins]]) * 6 + _KIND[data[ends - 1]]) * 5 + long) * 2 + again


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every n-gram that a text holds, each once, in order of rows."""
    data, first = text_bytes(column)
    out_row, out_column = [], []
    for a, b in runs_of_rows(first, 1 << 20):
        part = _LOWER[data[first[a]:first[b]]]
        raw = data[first[a]:first[b]]
        begins, ends = w.word_bounds(part, first[a + 1:b] - first[a])
        if not len(begins):
            continue
        rows = np.searchsorted(first[a + 1:b + 1] - first[a], begins, side="right")
        hashes = w.word_hashes(part, begins, ends)
        shapes = w.mixed(_shapes(raw, begins, ends, hashes, rows).astype(U) + U(1))
        two = (shapes[:-1] * w.M2) ^ shapes[1:]
        three = (two[:-1] * w.M3) ^ shapes[2:]
        grams = np.concatenate((hashes, shapes, w.mixed(two), w.mixed(three)))
        at = np.concatenate((rows, rows, np.where(rows[1:] == rows[:-1], rows[1:], -1),
                             np.where(rows[2:] == rows[:-2], rows[2:], -1)))
        code = (at[at >= 0] << COLUMN_BITS) | (grams[at >= 0] >> U(64 - COLUMN_BITS)).astype(np.int64)
        code = np.unique(code)
        out_row.append((code >> COLUMN_BITS) + a)
        out_column.append(code & (COLUMNS - 1))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_column)


# ------------------------------------------------------------------------------------------------ fitting
def log_count_ratios(sample: DataFrame, smoothing: float) -> np.ndarray:
    """Per column the log of its smoothed share in label 1 over that in label 0; counts are summed by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, COLUMNS), np.int64)
        for batch in batches:
            row, col = indicators(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            np.add.at(total, (label[row], col), 1)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], ["col", "poor", "good"])

    counted = sample.select("text", "label").mapInArrow(count, "col long, poor long, good long").groupBy("col").agg(
        F.sum("poor").alias("poor"), F.sum("good").alias("good")).toPandas()
    n = dict(sample.groupBy("label").count().collect())
    poor, good = np.zeros(COLUMNS), np.zeros(COLUMNS)
    poor[counted["col"]], good[counted["col"]] = counted["poor"], counted["good"]
    share = lambda x, of: (x + smoothing) / (of + 2 * smoothing)
    return np.log(share(good, n.get(1, 0)) / share(poor, n.get(0, 0)))


def vectors(row: np.ndarray, col: np.ndarray, n: int, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values beside ``col`` (weights scaled to length one a row) and where each row begins."""
    value = ratio[col]
    starts = np.searchsorted(row, np.arange(n + 1))
    square = np.bincount(row, weights=value * value, minlength=n)
    value = value / np.sqrt(np.maximum(square, 1e-12))[row]
    return value, starts


def dual_descent(col: np.ndarray, value: np.ndarray, starts: np.ndarray, label: np.ndarray, cost: np.ndarray,
                 rounds: int, columns: int = COLUMNS) -> np.ndarray:
    """Weights (the last is the constant) that minimise |w|^2 / 2 + sum of cost * hinge loss.

    Each step sets one dual variable, between 0 and its cost, to its best value with all others held.
    """
    weight, alpha = np.zeros(columns + 1), np.zeros(len(label))
    sign = np.where(label > 0, 1.0, -1.0)
    square = np.array([value[a:b] @ value[a:b] for a, b in zip(starts[:-1], starts[1:])]) + 1.0
    draw = np.random.default_rng(10)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(label)):
            a, b = starts[i], starts[i + 1]
            at, x = col[a:b], value[a:b]
            slope = sign[i] * (weight[at] @ x + weight[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weight[at] += step * sign[i] * x
                weight[-1] += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight


def logistic_curve(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton steps with a small ridge; a stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - label)
        h = weight * p * (1 - p)
        ga, gb = (g * margin).sum() + 1e-2 * a, g.sum() + 1e-2 * b
        haa, hab, hbb = (h * margin * margin).sum() + 1e-2, (h * margin).sum(), h.sum() + 1e-2
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(a - da, 1e-3), b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # ratio and hinge weight in one, float32
    ratio: np.ndarray
    constant: float
    a: float
    b: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        row, col = indicators(texts)
        top = np.bincount(row, weights=self.weight[col], minlength=n)
        square = np.bincount(row, weights=self.ratio[col] ** 2, minlength=n)
        margin = top / np.sqrt(np.maximum(square, 1e-12)) + self.constant
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | float:
    """The model, or where the labels have one class only, the share of label 1."""
    share = labelled.shares(labels, "quality", settings.folds, settings.fold)
    sample = settled(labelled.sample(docs, labels, "quality", settings.folds, settings.fold, settings.per_class), "quality-sample")
    if len(dict(sample.groupBy("label").count().collect())) < 2:
        return share
    # A fifth of the sample sets the curve, the rest weights and model.
    apart = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0
    ratio = log_count_ratios(sample.filter(~apart), settings.smoothing)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, col = indicators(batch.column("text"))
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            cols = pa.ListArray.from_arrays(pa.array(starts), pa.array(col.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("apart"), cols],
                                             ["doc_id", "label", "apart", "cols"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.withColumn("apart", apart).mapInArrow(listed, f"doc_id {kind}, label int, apart boolean, cols array<int>").orderBy("doc_id").toArrow()
    lists = got.column("cols").combine_chunks()
    col = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    label = got.column("label").to_numpy().astype(float)
    seen = got.column("apart").to_numpy(zero_copy_only=False)
    value, starts = vectors(row, col, len(lists), ratio)
    # Each class has the weight it has among all labels.
    n1 = max(1.0, (label == 1).sum())
    n0 = max(1.0, (label == 0).sum())
    weight = np.where(label == 1, share / n1, (1 - share) / n0) * len(label)
    train = np.flatnonzero(~seen)
    take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in train]) if len(train) else np.zeros(0, np.int64)
    sizes = np.diff(starts)[train]
    hinge = dual_descent(col[take], value[take], np.concatenate(([0], np.cumsum(sizes))), label[train],
                         np.full(len(train), settings.cost), settings.rounds)
    margin = np.bincount(row, weights=value * hinge[col], minlength=len(lists)) + hinge[-1]
    curve = np.flatnonzero(seen) if seen.any() else train
    a, b = logistic_curve(margin[curve], label[curve], weight[curve])
    return Model((hinge[:-1] * ratio).astype(np.float32), ratio.astype(np.float32), float(hinge[-1]), a, b)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns are ignored and no input
    of a score. Null and empty texts hold no n-gram and get the score of the model's constant. With
    labels of one class only, every score is that class's share; without labels it is 0.5. A null
    doc_id is not held out. Repeated rows are scored one by one.
    """
    model = fit(docs, labels, settings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores(batch.column("text")) if isinstance(model, Model) else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.astype(np.float64))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return rows.select("doc_id", labelled.held_out(F.col("doc_id"), settings.folds, settings.fold).alias("held_out"), "score",
                       (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
