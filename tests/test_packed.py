"""Postings of whole chunks as 32-bit numbers: the same index and answers as a row for each word."""

import numpy as np
import pytest

from docweft.operators import covers, fulltext
from tests.test_fulltext import QUESTIONS, tokens

TEXTS = [None, "", " \n", "Red FOX runs", "ünï red\nfox-27 ISTANBULİ Kelvin runnings", "é" * 50 + "fox", "the of", "red", "nation nations stations ations"] + ["red fox the blue pump fr 27 " * n for n in range(1, 40)]


@pytest.mark.parametrize("cut", [1, 100, 1 << 24])
def test_packed_words_are_the_index(spark, monkeypatch, cut):
    monkeypatch.setattr(fulltext, "CUT_BYTES", cut)
    known = sorted({w for t in TEXTS for _, w in tokens(t)} - {"blue"}) + ["absent"]
    chunks = spark.createDataFrame([*enumerate(TEXTS), (None, "red")], "chunk_id long, content string")
    got = {}
    for r in fulltext.packed(chunks, known).collect():
        words, places = np.frombuffer(r.words, np.int32), np.frombuffer(r.places, np.int32)
        assert r.n == len(words) == len(places)
        got[r.chunk_id] = [(int(p), known[w]) for p, w in zip(places, words, strict=True)]
    want = {i: [(p, w) for p, w in tokens(t) if w != "blue"] for i, t in enumerate(TEXTS)}
    assert got == {i: x for i, x in want.items() if x}
    rows = {(r.lexeme, r.chunk_id, r.pos) for r in fulltext.positions(chunks).where("chunk_id IS NOT NULL AND lexeme <> 'blue'").collect()}
    assert rows == {(w, i, p) for i, x in got.items() for p, w in x}


@pytest.mark.parametrize("most", [3, 1 << 18])
def test_find_equals_search(spark, monkeypatch, most):
    """Over several columns and blocks; also with more words than go to every task, and a chunk that comes in two rows."""
    monkeypatch.setattr(covers, "COLUMN_POSTINGS", 50)
    monkeypatch.setattr(covers, "BLOCK_QUESTIONS", 5)
    monkeypatch.setattr(fulltext, "MOST_WORDS", most)
    chunks = spark.createDataFrame([*enumerate(TEXTS), (None, "red fox"), (7, "blue fox")], "chunk_id long, content string")
    asked = fulltext.units(spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string"))
    want = {tuple(r) for r in fulltext.search(None, fulltext.positions(chunks), 5, asked).collect()}
    assert want and {tuple(r) for r in fulltext.find(asked, chunks, 5).collect()} == want


def test_an_index_without_rows_is_never_written(spark, monkeypatch):
    """The query's texts must not become one row for each word."""
    monkeypatch.setattr(fulltext, "positions", None)
    chunks = spark.createDataFrame([(1, "red fox")], "chunk_id long, content string")
    asked = fulltext.units(spark.createDataFrame([(1, "fox")], "question_id long, question string"))
    assert [tuple(r) for r in fulltext.find(asked, chunks, 5).collect()] == [(1, 1, 0.1, 1)]
    nothing = fulltext.units(spark.createDataFrame([(1, "-fox"), (2, None)], "question_id long, question string"))
    assert fulltext.find(nothing, chunks, 5).count() == fulltext.find(asked, chunks.where("chunk_id > 1"), 5).count() == 0
