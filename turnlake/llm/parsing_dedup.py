"""Removing repeated passages by relative Lempel-Ziv parsing.

Stretches of words that share a gram are dealt to the same shard. A block of a shard is indexed once:
where each sequence of ``window`` words starts, the smallest document first. Every stretch is then
factored greedily against that reference: at a word whose window the reference has in a smaller
document, the factor is carried on for as long as both texts agree; elsewhere a single word is passed
over. All words of a factor are repeated. A window that begins inside one factor and ends beyond it may
still be found in yet another document, so the windows over each factor's end are looked up as well.

All stretches of a block are factored side by side, one factor of each per step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm import windows as w
from turnlake.llm.common import runs_of_rows, text_bytes

U = np.uint64
GRAM = 4


def word_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the number of each text's first word."""
    data, first = text_bytes(column)
    hashes, counts = [], [np.zeros(1, np.int64)]
    for a, b in runs_of_rows(first, 1 << 21):
        part = data[first[a]:first[b]]
        begins, ends = w.word_bounds(part, first[a + 1:b] - first[a])
        hashes.append(w.word_hashes(part, begins, ends))
        counts.append(np.diff(np.searchsorted(begins, first[a:b + 1] - first[a])))
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.cumsum(np.concatenate(counts))


class Reference:
    """The windows of a block by their words: for each the document and place where it starts first."""

    def __init__(self, block: dict, window: int):
        self.values, self.first, self.window = block["values"], block["first"], window
        n = block["n"]
        self.owner = np.repeat(np.arange(len(n)), n)
        self.inside = np.arange(len(self.owner)) - np.repeat(np.cumsum(n) - n, n)
        self.at = self.first[self.owner] + self.inside
        self.doc = block["doc"][self.owner]
        # Two hashes of a window's words stand for it.
        a, b = np.zeros(len(self.at), U), np.full(len(self.at), w.M3)
        for i in range(window):
            word = self.values[self.at + i]
            a = (a ^ word) * w.M1
            a ^= a >> U(31)
            b = (b + word) * w.M2
            b ^= b >> U(30)
        order = np.lexsort((self.at, self.doc, b, a))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        self.source = np.empty(len(order), np.int64)
        self.source[order] = lead  # of each window, the window that is first to say the same
        self.found = self.doc[self.source] < self.doc


def judge(block: dict, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a block that also start in a smaller document, as spans of words."""
    reference = Reference(block, window)
    values, first, n = block["values"], block["first"], block["n"]
    window_of = np.cumsum(n) - n  # number of each stretch's first window
    live, at = np.arange(len(n)), np.zeros(len(n), np.int64)
    out_row, out_from, out_to = [], [], []

    def mark(rows, begin, end) -> None:
        out_row.append(rows)
        out_from.append(begin)
        out_to.append(end)

    while len(live):
        here = window_of[live] + at
        hit = reference.found[here]
        rows, begin = live[hit], at[hit]
        length = np.full(len(rows), window, np.int64)
        if len(rows):
            # Carry each factor on while the reference and the text agree, inside their stretches.
            source = reference.source[here[hit]]
            there = reference.at[source]
            room = np.minimum(first[rows + 1] - first[rows] - begin, first[reference.owner[source] + 1] - there)
            growing = np.flatnonzero(length < room)
            while len(growing):
                agree = values[first[rows[growing]] + begin[growing] + length[growing]] == values[there[growing] + length[growing]]
                growing = growing[agree]
                length[growing] += 1
                growing = growing[length[growing] < room[growing]]
            mark(rows, begin, begin + length)
            # Windows over the factor's end: each may be found elsewhere.
            for back in range(1, window):
                start = begin + length - back
                real = (start > begin) & (start < n[rows])
                real[real] = reference.found[window_of[rows[real]] + start[real]]
                mark(rows[real], start[real], start[real] + window)
        at = at + 1
        at[hit] = begin + length
        go = at < n[live]
        live, at = live[go], at[go]
    if not out_row:
        return (np.zeros(0, np.int64),) * 3
    row, begin, end = np.concatenate(out_row), np.concatenate(out_from), np.concatenate(out_to)
    return block["doc"][row], block["start"][row] + begin, block["start"][row] + end


def words_of(window: int) -> w.Cells:
    if window <= GRAM:
        raise ValueError(f"windows have more than {GRAM} words")
    return w.Cells(window, GRAM, word_cells, w.word_grams(GRAM), w.word_probes(window), within_document=False)


def deduplicated(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """Per document doc_id, n_words, n_removed, kept_sha256 and, if asked, clean_text (the kept words, one space between).

    A word goes if ``window`` words around it also start in a document with a smaller doc_id; what a
    document repeats of itself stays. Words are compared by 64-bit hashes. ``docs`` needs doc_id (a
    whole number) and text; other columns are ignored. Null text has no words. A row with a null doc_id is
    returned as it is and removes nothing. Rows that repeat a doc_id and its text are the same document: none
    removes the other, and each loses what the others lose. Rows that repeat a doc_id with another text are
    documents of their own: the text with the least 64-bit hash stands at the place of doc_id, the others come
    behind all documents. An empty table gives an empty one. Texts of any length are cut into stretches, so
    only reading a text takes memory of its size.
    """
    docs = w.keyed(docs.select("doc_id", "text"), "parsing")
    spans = w.repeated_spans(docs.select(F.col("_key").alias("doc_id"), "text"), words_of(window), lambda block: judge(block, window), "parsing")
    spans = spans.withColumnRenamed("doc_id", "_key")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                kept, at = [], 0
                for a, b in w.covered(batch.column("spans"), i, len(words)):
                    kept.extend(words[at:a])
                    at = b
                kept.extend(words[at:])
                left = b" ".join(kept)
                rows[0].append(len(words))
                rows[1].append(len(words) - len(kept))
                rows[2].append(hashlib.sha256(left).hexdigest())
                if with_text:
                    rows[3].append(left.decode("utf-8", "replace"))
            out = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(rows[3], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", clean_text string" * with_text
    return docs.join(spans, "_key", "left").mapInArrow(finish, schema)
