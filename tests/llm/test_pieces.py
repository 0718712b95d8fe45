"""Encoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from loomstrand.llm import pieces, queries
from loomstrand.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts_are_encoded_as_by_the_library(library):
    random.seed(3)
    signs = ["  ", "▁", "ab", "the", "é", "\n", "\r\n", "\t", "0", "12", "陳", "👍", "<s>", "</s>", "\0", "…", "tion", "́", "﷽", "<0x41>"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(3_000)]
    ids, agrees = pieces.Agenda(MODEL).encode(texts)
    assert ids == library.encode(texts, add_eos=True) and all(agrees)


def test_scan_and_heap_merge_alike(library):
    encoder = pieces.Agenda(MODEL)
    for text in ("the" * 40, "abcabcabd" * 30, "internationalisation" * 9, "▁" * 77):
        assert encoder._by_scan(list(text)) == encoder._by_heap(list(text))
    long = "unbroken" * 20_000
    assert encoder.encode([long])[0][0] == library.encode(long, add_eos=True)


def test_a_wrong_segment_is_noticed():
    encoder = pieces.Agenda(MODEL)
    del encoder.order["▁the"]
    assert encoder.encode(["one two", "the hat"])[1] == [True, False]


def test_nulls_empty_texts_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, " a  b\n", "z")]
    found = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL)
    assert found.columns == ["doc_id", "text", "ids", "decoded", "agrees"]
    got = sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in found.collect())
    odd = library.encode(" a  b\n", add_eos=True)
    assert got == [(0, odd, library.decode(odd)), (1, [2], ""), (2, [2], ""), (2, [2], "")]
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_query_against_the_library(spark, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for r in table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "", add_eos=True)
        expected.add((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), True))
    assert {tuple(r) for r in queries.op12_pieces(spark, SF).collect()} == expected
