"""Equal windows across documents, found without meeting all windows.

A window is ``window`` cells on end (bytes, or words by their hash). Each window is put under one of the
grams inside it, the one with the least key, leftmost of equals. Equal windows choose the same gram at
the same place, so windows of different grams never need to meet. Windows side by side that chose the
same gram form a stretch: about one row for every (window - gram) / 2 cells.

Equal stretches (same gram, same cells) are recognised by two 64-bit hashes and only the first of
them goes on; that is what keeps groups of copies small. What is left and still shares a gram goes,
with its cells, to the shards, where an index over the cells themselves decides.

Grams found in many documents of a sample rank behind all others, so that a line in a third of all
documents is not the key of all windows around it. The sample moves work between tasks only; any
set of frequent grams gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import column, settled, sliced, whole_partition

U = np.uint64
#: Odd multipliers of the mixing steps, from the golden ratio and the square roots of 3 and 5. Fixed values.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBB67AE8584CAA73B), U(0x3C6EF372FE94F82B)
PLACE_BITS = 22
FREQUENT_BITS = 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x ^= x >> U(32)
    x = x * M2
    x ^= x >> U(29)
    return x


@dataclass(frozen=True)
class Cells:
    """One kind of cell. ``read`` turns a batch of texts into (cells, first cell of each text);
    ``grams`` hashes the gram at every place; ``word_at`` gives cells as 64-bit values for hashing."""

    window: int
    gram: int
    read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray], np.ndarray]
    probes: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]
    at_once: int = 1 << 20
    within_document: bool = True


@dataclass
class Stretches:
    row: np.ndarray
    start: np.ndarray
    offset: np.ndarray
    n: np.ndarray
    gram: np.ndarray
    mark: np.ndarray


def spans_of_rows(first: np.ndarray, cells: Cells) -> Iterator[tuple[int, int]]:
    """Stretches of cells to work on at once: whole rows, or overlapping parts of a very long row."""
    row, n = 0, len(first) - 1
    while row < n:
        end = int(np.searchsorted(first, first[row] + cells.at_once, side="right")) - 1
        if end > row:
            yield int(first[row]), int(first[end])
            row = end
            continue
        for at in range(int(first[row]), int(first[row + 1]), cells.at_once):
            yield at, min(at + cells.at_once + cells.window - 1, int(first[row + 1]))
        row += 1


def stretches(values: np.ndarray, first: np.ndarray, cells: Cells, frequent: np.ndarray | None = None) -> Stretches:
    """All stretches of a batch: row, first window's place in its text, place of the gram, windows, hashes."""
    span = cells.window - cells.gram + 1
    low = U((1 << PLACE_BITS) - 1)
    found = []
    for begin, end in spans_of_rows(first, cells):
        if end - begin < cells.window:
            continue
        grams = cells.grams(values[begin:end])
        key = grams
        if frequent is not None:
            key = (grams >> U(1)) | (frequent[grams >> U(64 - FREQUENT_BITS)].astype(U) << U(63))
        key = (key & ~low) | np.arange(len(grams), dtype=U)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
        # Windows that cross from one text into the next are none.
        inside = np.ones(len(key), dtype=bool)
        edges = first[np.searchsorted(first, begin, side="right"):np.searchsorted(first, end, side="left")] - begin
        for edge in edges:
            inside[max(0, edge - cells.window + 1):edge] = False
        place = np.flatnonzero(inside)
        if not len(place):
            continue
        gram_at = (key[place] & low).astype(np.int64)
        change = np.flatnonzero(gram_at[1:] != gram_at[:-1]) + 1
        lead = np.concatenate(([0], change))
        n = np.diff(np.concatenate((lead, [len(place)])))
        start, gram_at = place[lead], gram_at[lead]
        mark = mixed((n.astype(U) << U(32)) + (gram_at - start).astype(U))
        # The first and the last window of a stretch hold all its cells.
        for side in (start, start + n - 1):
            for word in cells.probes(values[begin:end], side):
                mark = (mark ^ word) * M3
                mark ^= mark >> U(31)
        row = np.searchsorted(first, start + begin, side="right") - 1
        found.append((row, start + begin - first[row], gram_at - start, n, grams[gram_at], mark))
    if not found:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none, none.astype(U), none.astype(U))
    return Stretches(*(np.concatenate(x) for x in zip(*found)))


# ---------------------------------------------------------------------------------------------- bytes
def wide(values: np.ndarray) -> np.ndarray:
    """At every place the 8 bytes from there on, as a number whose order is theirs."""
    padded = np.concatenate((values, np.zeros(8, np.uint8)))
    return np.ndarray((len(values),), dtype=">u8", buffer=padded, strides=(1,)).astype(U)


def byte_grams(values: np.ndarray) -> np.ndarray:
    """Hashes of 32-byte grams: four mixed words of 8 bytes."""
    words = wide(values) * M1
    words ^= words >> U(32)
    n = len(values) - 31
    out = words[:n] * M2
    out += words[8:8 + n]
    out *= M3
    out += words[16:16 + n]
    out *= M2
    out += words[24:24 + n]
    out ^= out >> U(32)
    out *= M1
    out ^= out >> U(29)
    return out


def byte_probes(window: int):
    def probes(values: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        words = wide(values)
        for i in range(0, window - 8, 8):
            yield words[at + i]
        yield words[at + window - 8]
    return probes


# ---------------------------------------------------------------------------------------------- words
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BYTE_VALUE[SPACE] = 0
BASE = 0x9E3779B97F4A7C13
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
TEXT_AT_ONCE = 1 << 20


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _POWERS:
        n = TEXT_AT_ONCE
        up = np.full(n, U(BASE))
        down = np.full(n, U(pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[0]


def word_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind it, of texts on end. ``edges`` are where texts begin: a word
    that runs on from one text into the next is two words."""
    blank = SPACE[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    split = edges[(edges > 0) & (edges < len(data))]
    split = np.unique(split[~blank[split] & ~blank[split - 1]])
    return np.sort(np.concatenate((begins, split))), np.sort(np.concatenate((ends, split)))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; words must lie in order."""
    out = np.empty(len(begins), U)
    up, down = _powers()
    at = 0
    while at < len(begins):
        origin = begins[at]
        to = int(np.searchsorted(ends, origin + TEXT_AT_ONCE, side="right"))
        if to <= at:  # one very long word
            total = U(0)
            for i in range(int(origin), int(ends[at]), TEXT_AT_ONCE):
                part = data[i:min(i + TEXT_AT_ONCE, int(ends[at]))]
                total = total * M3 + (BYTE_VALUE[part] * up[:len(part)]).sum(dtype=U)
            out[at] = total + U(int(ends[at] - origin))
            at += 1
            continue
        part = data[origin:ends[to - 1]]
        weighed = BYTE_VALUE[part] * up[:len(part)]
        lead = begins[at:to] - origin
        out[at:to] = np.add.reduceat(weighed, lead) * down[lead] + (ends[at:to] - begins[at:to]).astype(U)
        at = to
    return mixed(out)


def word_grams(gram: int):
    def grams(values: np.ndarray) -> np.ndarray:
        n = len(values) - gram + 1
        out = values[:n] * M1
        for i in range(1, gram):
            out ^= out >> U(31)
            out += values[i:i + n]
            out *= M2
        out ^= out >> U(29)
        return out
    return grams


def word_probes(window: int):
    def probes(values: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(window):
            yield values[at + i]
    return probes


# ------------------------------------------------------------------------------------------- the search
def first_of_equal(gram, mark, doc, start, within_document: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, and in it which stretches stay (they come first) and which repeat an earlier one."""
    order = np.lexsort((start, doc, mark, gram))
    gram, mark, doc, start = gram[order], mark[order], doc[order], start[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (mark[1:] != mark[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    if within_document:
        return order, new, (doc != doc[lead]) | (start != start[lead])
    return order, doc == doc[lead], doc != doc[lead]


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document in order, overlapping and touching ones as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    rank = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
    shift = rank * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    lead = np.flatnonzero(new)
    last = np.concatenate((lead[1:], [len(doc)])) - 1
    return doc[lead], start[lead], reach[last] - shift[last]


ROWS = "gram long, mark long, doc_id long, place long, span_end long"
#: In ``span_end``, for a stretch; other rows are spans known to be repeated, ``place`` their first cell.
OPEN = -1


def _batch(gram, mark, doc, place, span_end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (gram, mark, doc, place, span_end)],
        ["gram", "mark", "doc_id", "place", "span_end"])


def _packed(s: Stretches) -> np.ndarray:
    return (s.start << 16) | (s.offset << 8) | s.n


def _span_batch(doc, start, end) -> pa.RecordBatch:
    doc, start, end = merged_spans(doc, start, end)
    return _batch(mixed(doc.view(U)), np.zeros(len(doc), np.int64), doc, start, end)


def frequent_grams(docs: DataFrame, cells: Cells, one_in: int = 64, share: float = 1 / 256, most: int = 4096) -> np.ndarray | None:
    """A table of gram hash prefixes that many documents of a sample hold; at most ``most`` grams."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = stretches(*cells.read(batch.column("text")), cells)
            grams = np.unique(np.stack([s.row.view(U), s.gram]), axis=1)[1]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    least = max(8, int(sample.select("doc_id").count() * share))
    counted = sample.select("text").mapInArrow(of, "gram long").groupBy("gram").count().filter(F.col("count") >= least)
    found = [r[0] for r in counted.orderBy(F.desc("count"), "gram").limit(most).collect()]
    if not found:
        return None
    table = np.zeros(1 << FREQUENT_BITS, dtype=bool)
    table[np.array(found, dtype=np.int64).view(U) >> U(64 - FREQUENT_BITS)] = True
    return table


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``_key``, one whole number per document, in the order of doc_id.

    That is doc_id, but for rows that repeat a doc_id with another text. Of the texts of one doc_id the one
    with the least 64-bit hash stands at the place of doc_id; the others are documents behind all the rest,
    in the order of doc_id and hash. Rows with the same doc_id and text are one document. Where no doc_id
    repeats, which its column alone shows, nothing else is read.
    """
    docs = docs.withColumn("_key", F.col("doc_id").cast("long"))
    ids = settled(docs.filter("_key is not null").groupBy("_key").count().filter(F.col("count") > 1).select("_key"), f"{name}-ids")
    if ids.isEmpty():
        return docs
    digest = F.xxhash64("text")
    texts = settled(docs.filter("text is not null").select("_key", digest.alias("_digest")).join(ids, "_key", "left_semi").distinct(), f"{name}-texts")
    first = texts.groupBy("_key").agg(F.min("_digest").alias("_first"))
    behind = F.lit(docs.agg(F.max("_key")).first()[0]) + 1
    # The numbers follow the order of the sorted rows; written, they stay as they are.
    others = settled(texts.join(first, "_key").filter("_digest <> _first").orderBy("_key", "_digest").select(
        "_key", "_digest", (behind + F.monotonically_increasing_id()).alias("_other")), f"{name}-others")
    marked = docs.withColumn("_digest", F.when(F.col("text").isNotNull(), digest)).join(others, ["_key", "_digest"], "left")
    return marked.withColumn("_key", F.coalesce("_other", "_key")).drop("_digest", "_other")


def repeated_spans(docs: DataFrame, cells: Cells, judge: Callable[[dict], tuple], name: str) -> DataFrame:
    """doc_id and spans (array of start, end in cells; unmerged) covered by repeated windows.

    ``judge`` gets the stretches of one block of a shard (doc, start, n, their cells on end, where each
    begins) and returns (doc, start, end) of what is repeated there. Rows of one doc_id must have one text
    (see ``keyed``).
    """
    if cells.window - cells.gram + 1 > 255:
        raise ValueError(f"windows have at most {cells.gram + 254} cells for grams of {cells.gram}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    frequent = frequent_grams(docs, cells)
    wide_row = cells.window - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = stretches(*cells.read(batch.column("text")), cells, frequent)
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[s.row]
            order, stay, again = first_of_equal(s.gram, s.mark, doc, s.start, cells.within_document)
            keep, gone = order[stay], order[again]
            yield _batch(s.gram[keep], s.mark[keep], doc[keep], _packed(s)[keep], np.full(len(keep), OPEN))
            yield _span_batch(doc[gone], s.start[gone], s.start[gone] + s.n[gone] + wide_row)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_partition(batches)
        if table is None:
            return
        gram, mark, doc, place, end = (column(table, c) for c in ("gram", "mark", "doc_id", "place", "span_end"))
        span = end != OPEN
        yield _span_batch(doc[span], place[span], end[span])
        gram, mark, doc, place = gram[~span], mark[~span], doc[~span], place[~span]
        order, stay, again = first_of_equal(gram, mark, doc, place, cells.within_document)
        gone = order[again]
        start = place[gone] >> 16
        yield _span_batch(doc[gone], start, start + (place[gone] & 255) + wide_row)
        keep = order[stay]
        gram, mark, doc, place = gram[keep], mark[keep], doc[keep], place[keep]
        if not len(gram):
            return
        # Only grams with stretches of different cells (of different documents, if need be) go on.
        new = np.concatenate(([True], gram[1:] != gram[:-1]))
        other = np.concatenate(([False], (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1]))) if not cells.within_document else \
            np.concatenate(([False], mark[1:] != mark[:-1]))
        group = np.cumsum(new) - 1
        several = (np.bincount(group, weights=other & ~new) > 0)[group]
        yield _batch(gram[several], mark[several], doc[several], place[several], np.full(int(several.sum()), OPEN))

    met = settled(docs.mapInArrow(cut, ROWS).repartition("gram").mapInArrow(meet, ROWS), name)
    asked = met.filter(F.col("span_end") == OPEN).groupBy("doc_id").agg(F.collect_list(F.struct("gram", "place")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, first = cells.read(batch.column("text"))
            lists = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            entries = lists.flatten()
            gram = entries.field("gram").to_numpy(zero_copy_only=False)
            place = entries.field("place").to_numpy(zero_copy_only=False)
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            size = (place & 255) + wide_row
            at = first[row] + (place >> 16)
            for i in range(0, len(gram), 100_000):
                part = slice(i, i + 100_000)
                n, ends = size[part], np.cumsum(size[part])
                taken = values[np.repeat(at[part] - (ends - n), n) + np.arange(ends[-1])]
                offsets = np.concatenate(([0], ends)).astype(np.int32) * taken.itemsize
                body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken))])
                yield pa.RecordBatch.from_arrays([pa.array(gram[part]), pa.array(doc[part]), pa.array(place[part]), body],
                                                 ["gram", "doc_id", "place", "body"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_partition(batches)
        if table is None:
            return
        table = table.take(pa.array(np.argsort(column(table, "gram"), kind="stable")))
        gram, doc, place = (column(table, c) for c in ("gram", "doc_id", "place"))
        size = (place & 255) + wide_row
        ends = np.cumsum(size)
        begin, n = 0, len(gram)
        changes = np.concatenate((np.flatnonzero(gram[1:] != gram[:-1]) + 1, [n]))
        while begin < n:
            # As many whole groups as fit, one at least.
            reach = int(np.searchsorted(ends, ends[begin] - size[begin] + cells.at_once))
            cut_at = changes[max(np.searchsorted(changes, max(reach, begin + 1), side="right") - 1, 0)]
            if cut_at <= begin:
                cut_at = changes[np.searchsorted(changes, begin, side="right")]
            part = slice(begin, int(cut_at))
            body = table.column("body").slice(begin, int(cut_at) - begin).combine_chunks()
            body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
            at = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1]
            kind = np.uint8 if at[1] - at[0] == size[begin] else U
            values = np.frombuffer(body.buffers()[2], np.uint8)[at[0]:at[-1]].copy().view(kind)
            found = judge({"doc": doc[part], "start": place[part] >> 16, "n": place[part] & 255, "values": values,
                           "first": np.concatenate(([0], np.cumsum(size[part])))})
            if len(found[0]):
                a, b, c = merged_spans(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["doc_id", "place", "span_end"])
            begin = int(cut_at)

    bodies = docs.join(asked, "doc_id").mapInArrow(fetch, "gram long, doc_id long, place long, body binary").repartition("gram")
    judged = bodies.mapInArrow(shard, "doc_id long, place long, span_end long")
    spans = met.filter(F.col("span_end") != OPEN).select("doc_id", "place", "span_end").unionByName(judged)
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("place").alias("start"), F.col("span_end").alias("end"))).alias("spans"))


def covered(spans: pa.Array, row: int, limit: int) -> list[tuple[int, int]]:
    """The merged spans of one row, cut at ``limit`` cells."""
    value = spans[row]
    if not value.is_valid:
        return []
    entries = value.values
    start = entries.field("start").to_numpy(zero_copy_only=False)
    end = np.minimum(entries.field("end").to_numpy(zero_copy_only=False), limit)
    real = start < end
    _, start, end = merged_spans(np.zeros(int(real.sum()), np.int64), start[real], end[real])
    return list(zip(start.tolist(), end.tolist()))
