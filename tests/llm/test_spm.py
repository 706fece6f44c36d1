"""Encoding by distinct chunks against the library on whole texts."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.llm import spm

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLE = spm.ChunkTable(MODEL, entries=50)
HARD = ["", " ", "  a  b ", "a\tb\r\nc\n", "▁x▁ y", "é　x y", "\x00a", "😀 <s> </s>", "x" * 5000, " " * 300, "the " * 3000]


def same(texts):
    ids, decoded = TABLE.encode(texts)
    whole = LIBRARY.encode([t or "" for t in texts])
    assert [i.tolist() for i in ids] == whole
    assert decoded == LIBRARY.decode(whole)


def test_hard_texts():
    same(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=8))
def test_any_text(texts):
    same(texts)


@settings(max_examples=150, deadline=None)
@given(st.text("a▁ \n.é", max_size=60))
def test_markers(text):
    same([text])


def test_long_texts_in_parts(monkeypatch):
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(spm, "PART_CHARS", size)
        same([*HARD[:8], "a bc  def▁ghi   ", "word " * 200, None, " x" * 40])


def test_frame(spark):
    rows = [(1, None, 5, "x"), (1, None, 5, "x"), (2, "", None, "y"), (None, "two words", 1, "z")] + [(10 + i, t, i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = spm.digests(spm.encode(df, MODEL)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for key, text, *_ in rows:
        ids = LIBRARY.encode(text or "")
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert spm.encode(df.limit(0), MODEL).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in spm.encode(docs, MODEL).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text)
        assert got[r.doc_id].ids == ids and got[r.doc_id].decoded == LIBRARY.decode(ids)


def test_crossing_pieces_are_refused(monkeypatch):
    class Odd:
        vocab_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Odd())
    with pytest.raises(ValueError, match="cross"):
        spm.ChunkTable("any")
