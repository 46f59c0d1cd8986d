import hashlib
import random
import struct
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_fixtures import given, texts_table, words  # noqa: F401
from turnlake.llm import word_codec
from turnlake.llm.word_codec import WordCodec, encoded

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["", " ", "a", "  The  QUICK\t\nbrown ", "don't I'LL 'stop '''s it's", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext", "\0 \x1c\x1d a\x1fb \x7f",
           "ΑΣ ΟΔΟΣ İstanbul ẞ", "été 가 ﬁ ½ ² Ⅷ ٣", " x　y​z w﻿v᠎u", "漢字かな交じり文", "😀👩‍👩‍👧 é😀", "a" * 3000, "ab1" * 500, "!?" * 700,
           "1234567890", "\u0085x", " ́ a ́", "; Å"]


@pytest.fixture(scope="module")
def both():
    return WordCodec(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    ours, library = both
    wanted = library.encode(text, add_special_tokens=False).ids
    raw, back = ours.coded(text)
    assert raw == struct.pack(f"<{len(wanted)}I", *wanted), text[:80]
    assert back == library.decode(wanted, skip_special_tokens=False)
    assert ours.encode(text) == wanted and ours.decode(wanted) == back


def test_same_ids_and_texts_as_the_library(both, words, spark, given):
    pages = [r.html for r in spark.read.parquet(f"{given}/pages.parquet").limit(40).collect()]
    docs = [r.text for r in spark.read.parquet(f"{given}/documents.parquet").collect()]
    for text in AWKWARD + [t or "" for t in words] + pages + docs:
        same(both, text)


def test_characters_of_all_blocks(both):
    """Behind a letter and before a digit: spaces, cases and word classes are the library's."""
    whole = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 11 == 0)]
    for i in range(0, len(whole), 4096):
        same(both, " ".join(f"a{c}1" for c in whole[i:i + 4096]))
    for c in whole[:0x3100:7]:
        same(both, f"x{c}Y{c}{c}1")
    same(both, "".join(f"a{c}b\x1c" for c in whole[:0x3100] if c.isspace()))


def test_random_strings(both):
    draw = random.Random(3)
    pool = "abcdefstl'’ \n\t\x1c.,-_!0123éÉßΣσçœ́漢😀<|>"
    for _ in range(3000):
        same(both, "".join(draw.choice(pool) for _ in range(draw.randrange(40))))


def test_long_words_take_the_same_parts(both, monkeypatch):
    draw = random.Random(5)
    for _ in range(300):
        word = "".join(draw.choice("abcdelnorst") for _ in range(draw.randrange(1, 60)))
        assert both[0]._scanned(word) == both[0]._heaped(word)


def test_boundaries_and_ranks_of_a_short_word(both):
    """Every part is a token, and no two neighbours left have a rank."""
    parts = both[0]._scanned("antidisestablishmentarianism")
    assert "".join(parts) == "antidisestablishmentarianism</w>" and all(p in both[0].ids for p in parts)
    assert all(pair not in both[0].rank for pair in zip(parts, parts[1:]))


def test_forgetting_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(word_codec, "REMEMBERED", 3)
    ours, text = WordCodec(PATH), "one two three one four one five two six seven one eight"
    assert ours.encode(text) == both[1].encode(text, add_special_tokens=False).ids
    assert len(ours.known) <= 3 and len(ours.older) <= 3


def test_tables(spark, texts_table, words, both):
    rows = {r.doc_id: r for r in encoded(texts_table, PATH).collect()}
    for i, text in enumerate(words):
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    twice = encoded(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string"), PATH)
    assert sorted(r.n_tokens for r in twice.collect()) == [0, 2, 2, 2]


def test_a_word_is_merged_once(both, monkeypatch):
    """However many chunks it stands in, with other signs around it or in other case."""
    ours, merged = WordCodec(PATH), []
    parts = ours._parts
    monkeypatch.setattr(ours, "_parts", lambda w: merged.append(w) or parts(w))
    text = "Gathering gathering, (gathering) 'GATHERING' gathering. gathering;"
    assert ours.encode(text) == both[1].encode(text, add_special_tokens=False).ids
    assert merged.count("gathering") == 1
