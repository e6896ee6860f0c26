"""Piece BPE against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from cohortry.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = piece_bpe.PieceCodec(piece_bpe.read_model(PATH))
TEXTS = st.one_of(
    st.text(max_size=80), st.text("ab \n", max_size=300), st.text("etaoinsr ", max_size=200), st.text(" ▁", max_size=80),
    st.text("日本の中é😀1.\x00", max_size=60),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_same_pieces_as_the_library(texts):
    """Several texts are merged together."""
    for text, words in zip(texts, CODEC.encoded(texts), strict=True):
        ids = LIBRARY.encode(text)
        assert piece_bpe.ids_of(words) == ids
        assert CODEC.decode(ids) == LIBRARY.decode(ids) == CODEC.decoded(words).decode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31_999), max_size=12))
def test_any_pieces_decode_as_in_the_library(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", [
    " " * 5000, "a" * 20_000 + "b", "ab" * 3000, "\n" * 300, "<s>x</s><0x0A><unk>", "ineinungverheit" * 400, "  a   b    c     d" * 50,
    "漢字" * 2000, "﻿é́",
])
def test_long_runs(text):
    assert CODEC.encode(text) == LIBRARY.encode(text)


def test_rounds_and_single_steps_agree(monkeypatch):
    """Without rounds everything goes through the heap; a small memory is emptied all the time."""
    text = "the quick brown foxes    jumped " * 20 + "overandoverandover" * 30
    want = LIBRARY.encode(text)
    monkeypatch.setattr(piece_bpe, "ROUNDS", 0)
    assert piece_bpe.PieceCodec(CODEC.model).encode(text) == want
    monkeypatch.setattr(piece_bpe, "MEMORY", 2)
    codec = piece_bpe.PieceCodec(CODEC.model)
    assert [codec.encode(text) for _ in range(3)] == [want] * 3


def test_a_conflict_is_merged_in_order():
    """A new pair better than the round's own has to come before the next occurrence."""
    ranks = {"ab": 5, "aba": 1}
    model = piece_bpe.Model(("?", "a", "b", "ab", "aba", "<0x78>"), ranks | {"a": 8, "b": 9}, {ord("x"): 5}, frozenset(), 0, "?", False)
    codec = piece_bpe.PieceCodec(model)
    # one by one: a b a b a b -> ab a b a b -> aba b a b -> aba b ab
    assert codec.encode("ababab") == [4, 2, 3]
    assert codec.encode("abxxab") == [3, 5, 5, 3]


def test_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "<s> x"), (5, "é漢 " * 3000), (6, " ")]
    frame = documents(rows, extra=True)
    want = []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "")
        want.append(Row(
            doc_id=doc_id, n_tokens=len(ids), ids_sha256=hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            decoded_sha256=hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(),
        ))
    assert sorted(piece_bpe.round_trip(frame, PATH).collect(), key=str) == sorted(want, key=str)
    assert piece_bpe.round_trip(documents([]), PATH).count() == 0
    pieces = piece_bpe.with_pieces(frame, PATH, pieces="token_ids")
    assert sorted(pieces.columns) == sorted(frame.columns)
    back = piece_bpe.with_text(pieces, PATH, pieces="token_ids").select("text", "token_ids", "decoded").collect()
    assert all(r["decoded"] == LIBRARY.decode(r["token_ids"]) == (r["text"] or "") for r in back)


def test_parts_hold_all_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(piece_bpe, "CHARS", 10)
    texts = ["x" * n for n in (0, 3, 30, 5, 6, 1)] + [None, "y" * 11]
    parts = [t for _, t in piece_bpe._parts(pa.record_batch([pa.array(texts)], names=["text"]), "text")]
    assert [t for p in parts for t in p] == texts
    assert max(len(p) for p in parts) == 3 and np.all([len(p) for p in parts])


def test_whole_query(spark, data):
    """The registered query, on all texts."""
    from cohortry.llm.queries import QUERIES

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in QUERIES["op12_piece_bpe"](spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
