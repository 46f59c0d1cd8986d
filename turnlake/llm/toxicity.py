"""Toxicity by the nearest labelled examples.

Terms are words and word beginnings that go with the label: chosen from a bounded sample of labelled
documents by the log-likelihood ratio of their document counts. Every document becomes a vector of these
terms, weighted by term count and by rarity among all documents, of length one. Its nearest examples by
cosine are found exactly in an inverted index whose postings lie in blocks of examples: the largest
weight of each term in each block bounds what a block can reach, and blocks below the k-th best
similarity are passed over. Similarities weigh the neighbours' votes; the weighted vote becomes a
probability by a logistic curve fitted on the examples themselves, each left out of its own vote.

Bounds: ``per_class`` documents of each class, ``most_terms`` terms, so the index has a fixed greatest size.
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
from turnlake.llm.common import runs_of_rows, settled, tidy, text_bytes
from turnlake.llm.quality_model import logistic_curve

U = np.uint64


@dataclass(frozen=True)
class Settings:
    folds: int = 3
    fold: int = 1
    per_class: int = 4000
    most_terms: int = 2048
    #: Least documents of the sample with the term, and least log-likelihood ratio.
    least_documents: int = 4
    least_ratio: float = 20.0
    #: Least share of label 1 among the documents with the term, both classes weighed alike. Terms that are
    #: merely a little more frequent in one class would be in every text and tell nothing.
    least_share: float = 0.8
    neighbours: int = 15
    block: int = 64
    #: Lengths in bytes of the word beginnings that are terms of their own.
    beginnings: tuple[int, ...] = (4, 5, 6)
    threshold: float = 0.7
    #: Weights that what texts are like without neighbours may have in a vote, per neighbour asked for. The one under
    #: which the examples' labels are likeliest, each left out of its own vote, is taken.
    backgrounds: tuple[float, ...] = (0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.4)


#: Lower case, and a blank for whatever is neither letter nor digit nor part of a longer character.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 32


def terms(column: pa.Array, beginnings: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term hash) of all terms of a batch, repeats included, for some rows at a time."""
    data, first = text_bytes(column)
    for a, b in runs_of_rows(first, 1 << 20):
        part = _PLAIN[data[first[a]:first[b]]]
        begins, ends = w.word_bounds(part, first[a + 1:b] - first[a])
        if not len(begins):
            continue
        row = np.searchsorted(first[a + 1:b + 1] - first[a], begins, side="right")
        found = [w.word_hashes(part, begins, ends)]
        rows = [row]
        for n in beginnings:
            longer = ends - begins > n
            some = begins[longer]
            if not len(some):
                continue
            inside = np.zeros(len(part) + 1, np.int8)
            inside[some] += 1
            inside[some + n] -= 1
            cut = np.where(np.cumsum(inside[:-1]) > 0, part, np.uint8(32))
            found.append(w.mixed(w.word_hashes(cut, some, some + n) + U(n)))
            rows.append(row[longer])
        yield np.concatenate(rows) + a, np.concatenate(found)


def chosen_terms(sample: DataFrame, settings: Settings) -> np.ndarray:
    """Sorted hashes of the terms that go with the label; counts are summed by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for row, term in terms(batch.column("text"), settings.beginnings):
                order = np.lexsort((term, row))
                row, term = row[order], term[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
                term, good = term[new], label[row[new]] == 1
                both, at = np.unique(term, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both.view(np.int64)), pa.array(np.bincount(at, weights=good).astype(np.int64)),
                     pa.array(np.bincount(at, weights=~good).astype(np.int64))], ["term", "marked", "clean"])

    # Copies of one text are one witness: else every rare word of a copied text would look telling.
    sample = sample.groupBy("text").agg(F.max("label").alias("label"))
    n = dict(sample.groupBy("label").count().collect())
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    counted = sample.select("text", "label").mapInArrow(count, "term long, marked long, clean long").groupBy("term").agg(
        F.sum("marked").cast("double").alias("a"), F.sum("clean").cast("double").alias("b"))
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    all_with, share = a + b, n1 / max(1.0, n1 + n0)
    ratio = 2 * (part(a, all_with * share) + part(b, all_with * (1 - share)) + part(
        F.lit(n1) - a, (F.lit(n1 + n0) - all_with) * share) + part(F.lit(n0) - b, (F.lit(n1 + n0) - all_with) * (1 - share)))
    level = (a / n1) / (a / n1 + b / n0)
    best = counted.withColumn("ratio", ratio).filter((all_with >= settings.least_documents) & (F.col("ratio") >= settings.least_ratio) & (
        level >= settings.least_share))
    rows = best.orderBy(F.desc("ratio"), "term").limit(settings.most_terms).select("term").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(U))


def counted_terms(docs: DataFrame, chosen: np.ndarray, settings: Settings) -> DataFrame:
    """doc_id, the numbers of the chosen terms that the text holds, and how often."""
    known = np.zeros(1 << 16, dtype=bool)
    known[chosen >> U(48)] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times = [], []
            for row, term in terms(batch.column("text"), settings.beginnings):
                maybe = known[term >> U(48)]
                row, term = row[maybe], term[maybe]
                at = np.minimum(np.searchsorted(chosen, term), len(chosen) - 1)
                hit = chosen[at] == term
                code, n = np.unique(row[hit] * len(chosen) + at[hit], return_counts=True)
                codes.append(code)
                times.append(n)
            code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            n = np.concatenate(times) if times else np.zeros(0, np.int64)
            starts = pa.array(np.searchsorted(code, np.arange(batch.num_rows + 1) * len(chosen)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(starts, pa.array((code % len(chosen)).astype(np.int32))),
                 pa.ListArray.from_arrays(starts, pa.array(n.astype(np.int32)))], ["doc_id", "terms", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, terms array<int>, times array<int>")


def documents_with(vectors: DataFrame, n: int) -> np.ndarray:
    """For each of ``n`` terms how many documents hold it; tasks send sums, not rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], ["term", "n"])

    out = np.zeros(n, np.int64)
    for row in vectors.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


class BlockMaxIndex:
    """Examples as postings by term, in blocks of examples, with the largest weight of each term and block."""

    def __init__(self, ids: list, label: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], rarity: np.ndarray, block: int):
        self.rarity, self.block = rarity, block
        vectors = [self.vector(t, n) for t, n in lists]
        # Examples with the same strongest term lie together, so blocks have something to tell apart.
        strongest = np.array([t[np.argmax(v)] if len(t) else -1 for (t, _), v in zip(lists, vectors)], dtype=np.int64)
        order = np.lexsort((np.arange(len(ids)), label, strongest))
        self.ids, self.label = [ids[i] for i in order], label[order]
        term = np.concatenate([lists[i][0] for i in order] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([vectors[i] for i in order] or [np.zeros(0)])
        example = np.repeat(np.arange(len(order)), [len(lists[i][0]) for i in order])
        by_term = np.lexsort((example, term))
        self.example, self.weight = example[by_term].astype(np.int32), weight[by_term]
        self.starts = np.searchsorted(term[by_term], np.arange(len(rarity) + 1))
        code = term[by_term] * (len(order) // block + 1) + self.example // block
        lead = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        self.block_of = (self.example[lead] // block).astype(np.int32)
        self.block_max = np.maximum.reduceat(self.weight, lead) if len(lead) else np.zeros(0)
        self.block_starts = np.searchsorted(lead, self.starts)
        self.blocks = len(order) // block + 1

    def vector(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        value = (1 + np.log(times)) * self.rarity[term]
        return value / max(np.sqrt((value * value).sum()), 1e-12)

    def _scores(self, term: np.ndarray, value: np.ndarray, open_blocks: np.ndarray) -> np.ndarray:
        score = np.zeros(len(self.ids))
        for t, x in zip(term, value):
            part = slice(self.starts[t], self.starts[t + 1])
            example = self.example[part]
            use = open_blocks[example // self.block]
            score[example[use]] += x * self.weight[part][use]
        return score

    def nearest(self, term: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the k nearest examples that share a term; ties to the smaller number."""
        if not len(term) or not self.ids:
            return np.zeros(0, np.int64), np.zeros(0)
        value = self.vector(term, times)
        bound = np.zeros(self.blocks)
        for t, x in zip(term, value):
            part = slice(self.block_starts[t], self.block_starts[t + 1])
            bound[self.block_of[part]] += x * self.block_max[part]
        open_blocks = np.zeros(self.blocks, dtype=bool)
        # The most promising blocks set the bar; then every block that can still reach it is read.
        open_blocks[np.argsort(-bound, kind="stable")[:max(2, 2 * k // self.block + 1)]] = True
        score = self._scores(term, value, open_blocks)
        bar = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
        more = (bound >= bar - 1e-9) & (bound > 0)
        if (more & ~open_blocks).any():
            score = self._scores(term, value, more | open_blocks)
        found = np.flatnonzero(score > 0)
        best = found[np.argsort(-score[found], kind="stable")[:k]]
        return best, score[best]


@dataclass(frozen=True)
class Judge:
    index: BlockMaxIndex
    neighbours: int
    a: float
    b: float
    #: What documents without any term get, and its weight in a vote.
    otherwise: float
    background: float

    def vote(self, near: np.ndarray, similarity: np.ndarray) -> float:
        """Share of label 1 among the neighbours, the nearer the heavier. Examples far off say little:
        a weight for what texts are like without them keeps such votes near that."""
        weight = similarity / (1.0 - np.minimum(similarity, 0.99))
        return float(((weight * self.index.label[near]).sum() + self.background * self.otherwise) / (weight.sum() + self.background))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.a * (vote - 0.5) + self.b))))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame | None, Judge | float]:
    """Term vectors of all documents and the judge; or, where nothing can be learnt, the share of label 1."""
    share = labelled.shares(labels, "toxic", settings.folds, settings.fold)
    sample = settled(labelled.sample(docs, labels, "toxic", settings.folds, settings.fold, settings.per_class), "toxic-sample")
    if len(dict(sample.groupBy("label").count().collect())) < 2:
        return None, share
    chosen = chosen_terms(sample, settings)
    if not len(chosen):
        return None, share
    vectors = settled(counted_terms(docs, chosen, settings), "toxic-terms")
    n = vectors.count()
    rarity = np.log((1.0 + n) / (1.0 + documents_with(vectors, len(chosen)))) + 1.0
    got = counted_terms(sample, chosen, settings).join(F.broadcast(sample.select("doc_id", "label").distinct()), "doc_id").orderBy("doc_id").toArrow()
    lists = [(np.array(t, dtype=np.int64), np.array(c, dtype=float)) for t, c in zip(got.column("terms").to_pylist(), got.column("times").to_pylist())]
    label = got.column("label").to_numpy().astype(float)
    index = BlockMaxIndex(got.column("doc_id").to_pylist(), label, lists, rarity, settings.block)
    number = {d: i for i, d in enumerate(index.ids)}
    n1, n0 = max(1.0, (label == 1).sum()), max(1.0, (label == 0).sum())
    each = np.where(label == 1, share / n1, (1 - share) / n0) * len(label)
    found, rows = [], []
    for i, (d, (term, times)) in enumerate(zip(got.column("doc_id").to_pylist(), lists)):
        near, similarity = index.nearest(term, times, settings.neighbours + 1)
        other = near != number[d]
        if other.any():
            found.append((near[other][:settings.neighbours], similarity[other][:settings.neighbours]))
            rows.append(i)
    silent = np.setdiff1d(np.arange(len(label)), rows)
    otherwise = float(((each * label)[silent].sum() + share) / (each[silent].sum() + 1.0))
    return vectors, likeliest(index, settings, otherwise, found, label[rows], each[rows])


def likeliest(index: BlockMaxIndex, settings: Settings, otherwise: float, found: list, label: np.ndarray, each: np.ndarray) -> Judge:
    """The judge under whose background the labels of the examples are likeliest, given their neighbours without them."""
    best, judge = -np.inf, Judge(index, settings.neighbours, 1.0, 0.0, otherwise, settings.backgrounds[-1] * settings.neighbours)
    for per_neighbour in settings.backgrounds if found else ():
        background = per_neighbour * settings.neighbours
        plain = Judge(index, settings.neighbours, 1.0, 0.0, otherwise, background)
        votes = np.array([plain.vote(*x) for x in found])
        a, b = logistic_curve(votes - 0.5, label, each)
        p = np.clip(1 / (1 + np.exp(-(a * (votes - 0.5) + b))), 1e-12, 1 - 1e-12)
        fits = float((each * np.where(label == 1, np.log(p), np.log(1 - p))).sum())
        if fits > best:
            best, judge = fits, Judge(index, settings.neighbours, a, b, otherwise, background)
    return judge


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and evidence (nearest examples: id, label, similarity).

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic; other columns are ignored and no input of
    a score. Null and empty texts, and texts without a chosen term, have no neighbours: they get the
    share of label 1 among the examples without any. If labels are missing, of one class, or go with no
    term, every score is the share of label 1 (0.5 without labels). A null doc_id is not held out.
    Repeated rows are scored one by one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    evidence = f"array<struct<doc_id:{kind},label:int,similarity:double>>"
    vectors, judge = fit(docs, labels, settings)
    held = labelled.held_out(F.col("doc_id"), settings.folds, settings.fold).alias("held_out")
    predicted = (F.col("score") >= settings.threshold).cast("int").alias("predicted")
    if vectors is None:
        return docs.select("doc_id", F.lit(judge).alias("score")).select(
            "doc_id", held, "score", predicted, F.array().cast(evidence).alias("evidence"))

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            lists, counts = batch.column("terms"), batch.column("times")
            flat, times = lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            scores, why, at = [], [], 0
            for end in ends:
                term, n = flat[at:end], times[at:end]
                at = end
                key = term.tobytes() + n.tobytes()
                if key not in known:
                    near, similarity = judge.index.nearest(term, n.astype(float), judge.neighbours)
                    if len(known) > 5_000:
                        known.clear()
                    known[key] = (judge.score(judge.vote(near, similarity)) if len(near) else judge.otherwise, [
                        {"doc_id": judge.index.ids[i], "label": int(judge.index.label[i]), "similarity": float(s)}
                        for i, s in zip(near[:5], similarity[:5])])
                value, reasons = known[key]
                scores.append(value)
                why.append(reasons)
            names = ["doc_id", "score", "evidence"]
            kinds = pa.list_(pa.struct([("doc_id", batch.column("doc_id").type), ("label", pa.int32()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(why, kinds)], names)

    rows = vectors.mapInArrow(score, f"doc_id {kind}, score double, evidence {evidence}")
    return rows.select("doc_id", held, "score", predicted, "evidence")
