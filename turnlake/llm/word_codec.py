"""BPE encoding and decoding with word ends, by a contiguous array of ranks.

A text falls into chunks between white space, and a chunk (normalised) into words of letters, single digits,
signs and contractions; no merge crosses a word. A short word is an array of part boundaries beside the
ranks of adjacent parts: the least rank is found by scanning, its boundary is deleted, and the two
ranks next to the gap are looked up again, until no pair has a rank. Scanning is quadratic, so a word
of more than ``SHORT`` letters keeps its pairs in a heap over linked parts, which gives the same parts.

Normaliser and word pattern are the tokenizer file's own. ASCII chunks take a plain path of equal effect;
chunks and words seen before are remembered, each in two generations of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Words up to this many bytes are merged by scanning the rank array.
SHORT = 100
#: Chunks remembered in a worker: a full table becomes the older one of two.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64
NO_RANK = 1 << 60
#: Unicode white space, as the tokenizer's ``\s`` has it. Fixed value.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What str.split takes for space beyond that.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The file's word pattern on lower-case ASCII.
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+", re.ASCII)


class WordCodec:
    """Encoder and decoder of one tokenizer file: BPE over byte letters with a word-end suffix, no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.library = Tokenizer.from_file(path)
        self.normal, self.words = self.library.normalizer, self.library.pre_tokenizer
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.token_of = {i: t for t, i in self.ids.items()}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.token_of |= {i: t for t, i in self.special.items()}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("added tokens must stand for their plain text")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = {c for t in self.ids for c in t.removesuffix(self.end)}
        if len(letters) != 256 or any(c not in self.ids or c + self.end not in self.ids for c in letters):
            raise ValueError("a byte has no token")
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.merged: dict[str, tuple[bytes, str]] = {}
        self.merged_before: dict[str, tuple[bytes, str]] = {}

    def _scanned(self, word: str) -> list[str]:
        """Parts of a short word. The suffix belongs to the last letter."""
        whole, rank = word + self.end, self.rank
        bounds = list(range(len(word))) + [len(whole)]

        def at(i: int) -> int:
            """Rank of the parts on both sides of boundary i + 1."""
            return rank.get((whole[bounds[i]:bounds[i + 1]], whole[bounds[i + 1]:bounds[i + 2]]), NO_RANK)

        ranks = [at(i) for i in range(len(bounds) - 2)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = at(i)
            if i:
                ranks[i - 1] = at(i - 1)
        return [whole[a:b] for a, b in zip(bounds, bounds[1:])]

    def _heaped(self, word: str) -> list[str]:
        """The same parts for a long word: the least rank, the leftmost of equals, from a heap."""
        parts: list[str | None] = [*word[:-1], word[-1] + self.end]
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, str, str]] = []

        def push(i: int, j: int) -> None:
            found = self.rank.get((parts[i], parts[j]))
            if found is not None:
                heapq.heappush(heap, (found, i, parts[i], parts[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [p for p in parts if p is not None]

    def _parts(self, word: str) -> list[str]:
        return self._scanned(word) if len(word) <= SHORT else self._heaped(word)

    def _made(self, chunk: str) -> tuple[bytes, str]:
        if chunk.isascii():
            words = ASCII_WORDS.findall(chunk.lower()) if chunk.isprintable() else None
        else:
            words = None
        if words is None:
            words = [w for w, _ in self.words.pre_tokenize_str(self.normal.normalize_str(chunk))]
        seen = [self.merged.get(w) or self._merged(w) for w in words]
        return (b"".join([e[0] for e in seen]), " ".join([e[1] for e in seen])) if len(seen) != 1 else seen[0]

    def _merged(self, word: str) -> tuple[bytes, str]:
        """Ids and parts of a word. It stands in many chunks, with other signs around it or in other case, and is merged for the first."""
        entry = self.merged_before.get(word)
        if entry is None:
            parts = self._parts(word)
            entry = struct.pack(f"<{len(parts)}I", *[self.ids[p] for p in parts]), " ".join(parts)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.merged) >= REMEMBERED:
                self.merged_before, self.merged = self.merged, {}
            self.merged[word] = entry
        return entry

    def _known(self, chunk: str) -> tuple[bytes, str]:
        entry = self.older.get(chunk)
        if entry is None:
            entry = self._made(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[chunk] = entry
        return entry

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        chunks = text.split() if SEPARATORS.search(text) is None else [c for c in SPACE.split(text) if c]
        known, make = self.known.get, self._known
        return [known(c) or make(c) for c in chunks]

    def coded(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit numbers, and the text decoded from them."""
        if self.cut is None or not any(t in text for t in self.special):
            seen = self._plain(text)
        else:
            seen = []
            for piece in self.cut.split(text):
                if piece in self.special:
                    seen.append((struct.pack("<I", self.special[piece]), piece))
                else:
                    seen += self._plain(piece)
        return b"".join([e[0] for e in seen]), " ".join([e[1] for e in seen])

    def encode(self, text: str) -> list[int]:
        raw = self.coded(text)[0]
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """Tokens with spaces between, as a file without a decoder has it; ids that are none are left out."""
        return " ".join([self.token_of[i] for i in ids if i in self.token_of])


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec per worker process and tokenizer file."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, the ids themselves.

    ``docs`` needs doc_id and text; other columns are ignored. Null text is empty, and an empty or blank
    text has no ids and an empty decoded text. A very long text is coded whole: its words one by one, a
    long word by the heap. Rows are coded alone, so repeated rows and null ids repeat; there are no ties. An empty table
    gives an empty one. ``path`` is the tokenizer file, which every executor must have.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            counts, names, decoded, lists = [], [], [], []
            for text in batch.column("text"):
                raw, back = coder.coded(text.as_py() or "")
                counts.append(len(raw) // 4)
                names.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    lists.append(struct.unpack(f"<{len(raw) // 4}I", raw))
            out = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())]
            labels = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out.append(pa.array(lists, pa.list_(pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(out, labels)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(code, schema)
