"""Removing repeated substrings by suffix arrays.

Stretches of text that share a gram are dealt to the same shard, and a shard is sorted in blocks. Each
block's suffix array is made by two-stage sorting. A suffix is low if it is smaller than the one after
it. Only the low ones are sorted directly. The others follow from one scan over the buckets of first
bytes, in order: whoever stands before a suffix already placed, with a greater first byte, comes next in
the bucket of that byte. Common prefixes of neighbours then show which windows are equal.

Suffixes are sorted on as many bytes as a window has; what lies beyond can't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm import windows as w
from turnlake.llm.common import text_bytes

U = np.uint64


def low_suffixes(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the end of the text is smaller than all."""
    n = len(text)
    step = np.empty(n, np.int16)
    step[:-1] = text[1:].astype(np.int16) - text[:-1]
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the byte changes
    return step[at] > 0


def sorted_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in order of the ``depth`` bytes from there on; ``words`` holds 8 bytes for each place."""
    order = np.argsort(words[places], kind="stable")
    places = places[order]
    first = words[places]
    new = np.ones(len(places), dtype=bool)
    new[1:] = first[1:] != first[:-1]
    last = len(words) - 1
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        spot = np.flatnonzero(tied)
        if not len(spot):
            break
        group = np.cumsum(new[spot])
        some = places[spot]
        beyond = some + at
        key = np.where(beyond <= last, words[np.minimum(beyond, last)], U(0))
        order = np.lexsort((key, group))
        places[spot] = some[order]
        key = key[order]
        # Groups keep their places, so a place that began a group still does.
        split = np.zeros(len(spot), dtype=bool)
        split[1:] = (key[1:] != key[:-1])
        new[spot] |= split
    return places


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first ``depth`` bytes at least."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    low = low_suffixes(text)
    words = w.wide(text)
    direct = sorted_directly(words, np.flatnonzero(low), depth + 8)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    n_low = np.bincount(text[direct], minlength=256)
    low_from = np.concatenate(([0], np.cumsum(n_low)))
    out = np.empty(n, np.int64)
    # The last suffix is greater than the empty one after it: the first of its bucket.
    filled = heads.copy()
    out[filled[text[-1]]] = n - 1
    filled[text[-1]] += 1

    def induce(placed: np.ndarray, byte: int) -> np.ndarray:
        """Places what stands before ``placed`` in greater buckets; returns what belongs to the same."""
        before = placed[placed > 0] - 1
        bytes_before = text[before]
        above = bytes_before > byte
        go, to = before[above], bytes_before[above]
        order = np.argsort(to, kind="stable")
        go, to = go[order], to[order]
        counts = np.bincount(to, minlength=256)
        at = np.repeat(filled - (np.cumsum(counts) - counts), counts) + np.arange(len(go))
        out[at] = go
        filled[:] += counts
        return before[bytes_before == byte]

    for byte in np.flatnonzero(sizes):
        at = heads[byte]
        while at < filled[byte]:  # runs of the same byte fill their own bucket, one byte a round
            upto = filled[byte]
            same = induce(out[at:upto], byte)
            out[upto:upto + len(same)] = same
            filled[byte] += len(same)
            at = upto
        tail = direct[low_from[byte]:low_from[byte + 1]]
        out[ends[byte] - len(tail):ends[byte]] = tail
        induce(tail, byte)
    return out


def equal_neighbours(words: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """For each suffix but the first: whether it shares ``window`` bytes with the one before it."""
    same = np.arange(1, len(places))
    for at in [window - 8, *range(0, window - 8, 8)]:
        same = same[words[places[same] + at] == words[places[same - 1] + at]]
    out = np.zeros(len(places), dtype=bool)
    out[same] = True
    return out


def judge(block: dict, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a block that also start earlier, as spans of bytes."""
    text, first = block["values"], block["first"]
    owner = np.repeat(np.arange(len(block["n"])), block["n"])
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(block["n"]) - block["n"], block["n"])
    starts = first[owner] + inside
    which = np.full(len(text), -1, np.int64)
    which[starts] = np.arange(len(starts))
    places = suffix_array(text, window)
    places = places[which[places] >= 0]
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    linked = equal_neighbours(w.wide(text), places, window)
    doc, start = block["doc"][owner], block["start"][owner] + inside
    order = np.lexsort((start, doc))
    rank = np.empty(len(order), np.int64)
    moved = np.concatenate(([0], (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])))
    rank[order] = np.cumsum(moved)
    in_order = rank[which[places]]
    lead = np.flatnonzero(~linked)
    earliest = np.minimum.reduceat(in_order, lead)[np.cumsum(~linked) - 1]
    again = which[places[in_order > earliest]]
    return doc[again], start[again], start[again] + window


def bytes_of(window: int, gram: int = 32) -> w.Cells:
    if gram != 32 or window < 64:
        raise ValueError("grams have 32 bytes, windows 64 or more")
    return w.Cells(window, gram, text_bytes, w.byte_grams, w.byte_probes(window), at_once=1 << 21)


def deduplicated(docs: DataFrame, window: int = 100, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns of ``carry`` and, if asked, clean_text.

    A byte goes if some ``window`` bytes around it also start earlier: in a document with a smaller
    doc_id, or earlier in the same. ``docs`` needs doc_id (a whole number) and text; other columns
    are ignored. Null text is empty. A row with a null doc_id is returned as it is and removes nothing.
    Rows that repeat a doc_id and its text are taken as the same document at the same places: none removes
    the other, and each loses what the others lose. Rows that repeat a doc_id with another text are documents
    of their own: the text with the least 64-bit hash stands at the place of doc_id, the others come behind
    all documents. An empty table gives an empty one. Texts of any length are cut into stretches, so only
    reading a text takes memory of its size. clean_text leaves out characters that the cut broke.
    """
    docs = w.keyed(docs.select("doc_id", "text", *carry), "suffix")
    spans = w.repeated_spans(docs.select(F.col("_key").alias("doc_id"), "text"), bytes_of(window), lambda block: judge(block, window), "suffix")
    spans = spans.withColumnRenamed("doc_id", "_key")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, first = text_bytes(batch.column("text"))
            rows: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                body = data[first[i]:first[i + 1]].tobytes()
                cuts = w.covered(batch.column("spans"), i, len(body))
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(body[at:a])
                    at = b
                kept.append(body[at:])
                left = b"".join(kept)
                rows[0].append(len(body))
                rows[1].append(len(body) - len(left))
                rows[2].append(len(cuts))
                rows[3].append(hashlib.sha256(left).hexdigest())
                if with_text:
                    rows[4].append(left.decode("utf-8", "ignore"))
            out = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out.append(pa.array(rows[4], pa.string()))
                names.append("clean_text")
            for name in carry:
                out.append(batch.column(name))
                names.append(name)
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", clean_text string" * with_text
    schema += "".join(f", {name} {docs.schema[name].dataType.simpleString()}" for name in carry)
    return docs.join(spans, "_key", "left").mapInArrow(finish, schema)
