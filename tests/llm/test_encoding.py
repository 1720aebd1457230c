import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.encoding import decode_ids, encode_corpus, encode_text, pieces_of

TEXTS = [None, "", " ", "one two", "x" * 500, "a b " * 300, "\n\n  tab\tand  blanks   " * 40, "naïve café — ’s 12345 don't we'll " * 30, "ab" * 90 + " end", "<|endoftext|> is text", "語" * 200 + " 語語 ", "\x1c\x1d \x85a " * 60]


@pytest.mark.parametrize("chunk,overlap,block", [(16, 8, 40), (64, 16, 1 << 20), (1000, 10, 1000), (2048, 256, 100)])
def test_chunks_give_the_same_ids_as_whole_texts(spark, chunk, overlap, block):
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(TEXTS)), "text": pd.Series(TEXTS, dtype=object), "key": "clash", "ids": 1}), "doc_id bigint, text string, key string, ids int")
    got = {r.doc_id: list(r.ids) for r in encode_corpus(docs, "doc_id", "text", chunk=chunk, overlap=overlap, block=block).collect()}
    assert got == {i: encode_text(t) for i, t in enumerate(TEXTS)}


def test_the_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in TEXTS:
        assert encode_text(text) == (t.encode(text, add_special_tokens=False).ids if text else [])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1'.\n\t \x1c\x85é"), max_size=80), st.integers(1, 12), st.integers(1, 6))
def test_pieces_are_the_text_and_encode_like_it(text, chunk, overlap):
    pieces = pieces_of(text, chunk, overlap) if text else []
    assert "".join(pieces) == text
    assert [i for p in pieces for i in encode_text(p)] == encode_text(text)


def test_most_documents_are_cut_and_every_window_opens_a_piece_of_its_own():
    assert len(pieces_of("some words " * 1000)) == 6


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_round_trip(text):
    assert decode_ids(encode_text(text)) == text.encode()


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").collect() == []
