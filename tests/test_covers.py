"""Full text in tiles: several blocks and columns, repeated questions, alternatives that count although something excludes them."""

import numpy as np
import pyarrow as pa

from docweft.operators import covers, fulltext
from tests.test_fulltext import plain_score


def test_excluded_alternatives_still_count(spark, monkeypatch):
    monkeypatch.setattr(covers, "COLUMN_POSTINGS", 2000)
    monkeypatch.setattr(covers, "BLOCK_QUESTIONS", 2)
    texts = ["red " * 200 + "blue"] * 25 + ["green " * 3] * 90 + ["red " * 100 + "blue green"] + ["red green pump " * n for n in range(1, 9)]
    asked = ["red -blue or green", "red green", '"green pump" or blue', "red -blue or green", "red green", "pump"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    got = sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in fulltext.search(questions, fulltext.positions(chunks), 5).collect())
    want = []
    for q, question in enumerate(asked):
        scored = sorted((-s, i) for i, s in ((i, plain_score(question, t)) for i, t in enumerate(texts)) if s is not None)[:5]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    assert got == want
    assert (0, 1, 115, 10.1) in got


def test_rows_of_a_tile_come_in_any_order():
    """Words 1 and 2 in 200 chunks, asked alone, both, and one without the other; batches mix questions and postings."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 5, int(rng.integers(0, 40))) for _ in range(200)]
    rows = [(int(w), chunk * 7, pos, None) for chunk, text in enumerate(texts) for pos, w in enumerate(text)]
    rows += [(1, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 2), (1, 2, 0, 0), (2, 2, 1, 3)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    columns = list(zip(*rows, strict=True))
    table = pa.table({"word": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "pos": pa.array(columns[2], pa.int32()), "mark": pa.array(columns[3], pa.int64())})
    got = {(q, c): s for b in covers._met(200)(iter(table.to_batches(max_chunksize=97))) for q, c, s in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    want = {(0, i * 7): round(0.1 * (t == 1).sum(), 6) for i, t in enumerate(texts) if (t == 1).any()}
    want |= {(2, i * 7): s for i, t in enumerate(texts) if (t == 1).any() and not (t == 2).any() for s in [want[0, i * 7]]}
    assert {k: v for k, v in got.items() if k[0] != 1} == want
    assert {c for q, c in got if q == 1} == {i * 7 for i, t in enumerate(texts) if (t == 1).any() and (t == 2).any()}


def test_columns_of_a_task_share_what_was_found(spark, monkeypatch):
    """Many columns in two tasks: a task gives the best of all its columns once, not of each, with ties by chunk across columns."""
    monkeypatch.setattr(covers, "COLUMN_POSTINGS", 40)
    texts = ["red " * (i % 7) + "pump blue " * (i % 3) + "gap " * (i % 5) + "red" for i in range(300)]
    asked = ["red", "red blue", '"pump blue" or gap red', "red -gap", "blue -pump or gap pump"]
    posed = fulltext.units(spark.createDataFrame(list(enumerate(asked)), "question_id long, question string"))
    known = sorted({r.lexeme for r in posed.collect()})
    words = spark.createDataFrame([(w, i) for i, w in enumerate(known)], "lexeme string, word long")
    postings = fulltext.packed(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"), known)
    found = covers.best(posed.join(words, "lexeme"), postings, 5, 2).collect()
    for q, question in enumerate(asked):
        own = sorted((-r.score, r.chunk_id) for r in found if r.question_id == q)
        assert 5 <= len(own) <= 10
        assert own[:5] == sorted((-s, i) for i, s in ((i, plain_score(question, t)) for i, t in enumerate(texts)) if s is not None)[:5]


def test_rows_of_one_chunk_share_a_column(spark, monkeypatch):
    """A chunk in a long and a short row is one chunk, although a task takes the longest first and a column for every chunk."""
    monkeypatch.setattr(covers, "COLUMN_POSTINGS", 1)
    texts = [(i, "red pump " * i) for i in range(1, 30)] + [(40, "red " * 50), (40, "filler " * 60 + "pump")]
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    asked = fulltext.units(spark.createDataFrame([(1, "red pump")], "question_id long, question string"))
    got = {r.chunk_id: r.score for r in fulltext.find(asked, chunks, 50).collect()}
    assert set(got) == {*range(1, 30), 40} and got == {r.chunk_id: r.score for r in fulltext.search(None, fulltext.positions(chunks), 50, asked).collect()}
