"""SentencePiece encoding and decoding by a table of prefix ends.

In a merge-type vocabulary the encoding of a text ends, for each of its prefixes, in one token that is
the same whatever follows. An automaton over the pieces gives the tokens that end at a place; the one
whose start is the start of the text, or which the table's token for the prefix before it may precede,
is the prefix's last token. Two tokens may stand side by side if encoding their joined text gives
just these two. From the last entry the ids are read backwards.

Pieces hold the space mark only in front, so no merge crosses from a letter to a space mark and texts
fall into segments that are encoded on their own and remembered. Runs of marks are the one place where
pieces share a score: they are merged from the left, in a small table by length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
#: Segments remembered in a Python worker: a full table becomes the older one of two, and what is asked for again
#: moves back to the newer, so frequent words stay.
REMEMBERED = 250_000
#: Longer segments are encoded but not remembered.
LONGEST_REMEMBERED = 64


class PieceCodec:
    """Encoder and decoder of one model file: identity normalisation, byte fallback, a space mark in front."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids, self.id_bytes = {}, {}
        self.ids, self.score = {}, {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.id_bytes[i] = int(piece[3:5], 16)
            elif not model.is_control(i) and not model.is_unknown(i):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
        self.unknown = model.unk_id()
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        if any(piece.startswith(MARK * 2) and piece.strip(MARK) for piece in self.ids):
            raise ValueError("a piece holds several space marks before another character")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            # Some pieces never come out of merging; a token must be its own encoding.
            if piece.strip(MARK) == "" or self._merged(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.side_by_side: dict[int, bool] = {}
        self.segments = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+") if not any(
            "\n" in p for p in self.ids) else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.surface = [None if i in self.id_bytes else "" if i in self.silent else " ⁇ " if i == self.unknown else piece.replace(MARK, " ")
                        for i, piece in enumerate(self.pieces)]
        self.mark_runs: dict[int, list[int]] = {}

    def _merged(self, text: str) -> list[str]:
        """The definition on a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _may_precede(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        found = self.side_by_side.get(key)
        if found is None:
            a, b = self.pieces[left], self.pieces[right]
            found = self.side_by_side[key] = self._merged(a + b) == [a, b]
        return found

    def _marks(self, n: int) -> list[int]:
        """A run of ``n`` marks: equal scores, so the leftmost token grows while a piece allows it."""
        found = self.mark_runs.get(n)
        if found is None:
            longest = max(len(p) for p in self.ids if not p.strip(MARK))
            head, rest = divmod(n, longest)
            if head > 1 and rest:
                # The leftmost token fills up before its neighbour can begin, so all but the end is full.
                found = [self.ids[MARK * longest]] * (head - 1) + self._marks(longest + rest)
            elif not rest:
                found = [self.ids[MARK * longest]] * head
            else:
                found = [self.ids[p] for p in self._merged(MARK * n)]
            if len(self.mark_runs) < REMEMBERED:
                self.mark_runs[n] = found
        return found

    def _table(self, text: str) -> list[int]:
        """Ids of a segment with at most one mark, in front."""
        n, pieces, sides = len(text), len(self.pieces), self.side_by_side
        last, size = [-1] * n, [1] * n  # -1: a character that no piece holds
        for end, (token, length) in self.automaton.iter(text):
            if last[end] >= 0:
                continue  # there is one last token only
            before = end - length
            if before >= 0 and last[before] >= 0:
                fits = sides.get(last[before] * pieces + token)
                if not (self._may_precede(last[before], token) if fits is None else fits):
                    continue
            last[end], size[end] = token, length
        out, end = [], n - 1
        while end >= 0:
            token = last[end]
            if token >= 0:
                out.append(token)
            else:
                raw = text[end].encode("utf-8", "surrogatepass")
                out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(raw))
            end -= size[end]
        out.reverse()
        return out

    def segment_ids(self, segment: str) -> list[int]:
        body = segment.lstrip(MARK)
        marks = len(segment) - len(body)
        if not body:
            return self._marks(marks)
        if marks <= 1:
            return self._table(segment)
        tail = self._table(MARK + body)
        if tail[0] == self.ids.get(MARK):
            return self._marks(marks) + tail[1:]
        return self._marks(marks - 1) + tail

    def text_of(self, ids: list[int]) -> str:
        """The surface of ids, space marks as spaces; the mark in front of the text not yet dropped."""
        parts = [self.surface[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out, raw = [], bytearray()
        for i, part in zip(ids, parts):
            if part is None:
                raw.append(self.id_bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(part)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def _known(self, segment: str) -> tuple[str, int, str]:
        entry = self.older.get(segment)
        if entry is None:
            ids = self.segment_ids(segment)
            entry = (",".join(map(str, ids)), len(ids), self.text_of(ids))
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[segment] = entry
        return entry

    def coded(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, how many, and the text decoded from them."""
        if not text:
            return "", 0, ""
        seen, make = [], self._known
        for segment in self.segments.findall(MARK + text.replace(" ", MARK)):
            seen.append(self.known.get(segment) or make(segment))
        decoded = "".join([e[2] for e in seen])
        return ",".join([e[0] for e in seen]), sum([e[1] for e in seen]), decoded[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.coded(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker process and model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, the ids themselves.

    ``docs`` needs doc_id and text; other columns are ignored. Null text is empty: no ids, empty
    decoded text. Rows are coded one by one, so repeated rows repeat. ``path`` is the model file,
    which every executor must have.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column("text"):
                joined, n, decoded = coder.coded(text.as_py() or "")
                columns[0].append(n)
                columns[1].append(hashlib.sha256(joined.encode()).hexdigest())
                columns[2].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    columns[3].append([int(x) for x in joined.split(",")] if joined else [])
            out = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                   pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out.append(pa.array(columns[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(code, schema)
