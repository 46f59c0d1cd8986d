import hashlib

import public_tokenizers
import pytest
import sentencepiece

from llm_fixtures import given, texts_table, words  # noqa: F401
from turnlake.llm.piece_codec import PieceCodec, encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["", " ", "  ", "a", " a", "a ", "the  quick   brown", "\n\n", "a\nb \n c", "▁", "a▁b", "▁▁ x", "\0", "😀 😀é漢字", "<s> </s> <unk> <0x0A>",
           *(" " * n for n in range(3, 60)), *(" " * n + "the" for n in range(20)), "a" * 300, "ab" * 200, "\t\t", "ééé", "don't 1234567"]


@pytest.fixture(scope="module")
def both():
    return PieceCodec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_and_texts_as_the_library(both, words, spark, given):
    ours, library = both
    pages = [r.html for r in spark.read.parquet(f"{given}/pages.parquet").limit(40).collect()]
    docs = [r.text for r in spark.read.parquet(f"{given}/documents.parquet").collect()]
    for text in AWKWARD + [t or "" for t in words] + pages + docs:
        joined, n, decoded = ours.coded(text)
        ids = library.encode(text)
        assert joined == ",".join(map(str, ids)) and n == len(ids), text[:80]
        assert decoded == library.decode(ids)
        assert ours.encode(text) == ids and ours.decode(ids) == decoded


def test_one_last_token_for_each_prefix(both):
    ours, library = both
    text = "▁antidisestablishmentarianism"
    for n in range(1, len(text) + 1):
        assert ours._table(text[:n])[-1] == library.encode(text[1:n])[-1] if n > 1 else True


def test_forgetting_changes_nothing(both, monkeypatch):
    import turnlake.llm.piece_codec as module
    monkeypatch.setattr(module, "REMEMBERED", 3)
    ours, text = PieceCodec(PATH), "one two three one four one five two six seven one eight"
    assert ours.encode(text) == both[1].encode(text)
    assert len(ours.known) <= 3 and len(ours.older) <= 3


def test_tables(spark, texts_table, words, both):
    rows = {r.doc_id: r for r in encoded(texts_table, PATH).collect()}
    for i, text in enumerate(words):
        ids = both[1].encode(text or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()
    assert encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert encoded(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), PATH).first().n_tokens == 2
