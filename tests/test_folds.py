"""Folds along documents equal plain loops, whether a document lies in one task or in many."""

import numpy as np
import pytest

from docweft.operators import folds


def plain(rows, fold):
    out, state = {}, {}
    for document, place, row, *values in sorted(rows, key=lambda r: r[:3]):
        state[document], told = fold.step(state.get(document, fold.start()), *values)
        out[document, row] = told
    return out


@pytest.mark.parametrize("sizes", [[4000, 3, 1], [5] * 40, [0]])
def test_headings(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(d, i, d * 10000 + i, int(rng.choice([1, 2, 3, 5], p=[0.02, 0.18, 0.4, 0.4])), f"h{i}") for d, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, "document_id long, place long, chunk_id long, level int, heading string").repartition(5)
    fold = folds.HeadingStack()
    got = folds.along_documents(frame, fold, "document_id", "place", "chunk_id").collect()
    assert {(r.document_id, r.chunk_id): r.path for r in got} == plain(rows, fold) and len(got) == len(rows)


@pytest.mark.parametrize("sizes", [[3000, 2], [7] * 30])
def test_packing(spark, sizes):
    rng = np.random.default_rng(2)
    rows = [(d, i, d * 10000 + i, int(t)) for d, n in enumerate(sizes) for i, t in enumerate(rng.integers(0, 90, n))]
    frame = spark.createDataFrame(rows, "document_id long, place long, chunk_id long, tokens long").repartition(5)
    fold = folds.SkipPacking(600)
    got = folds.along_documents(frame, fold, "document_id", "place", "chunk_id").collect()
    assert {(r.document_id, r.chunk_id): (r.used, r.included) for r in got} == plain(rows, fold) and len(got) == len(rows)


def test_summaries_compose():
    import pandas as pd

    rng, fold = np.random.default_rng(3), folds.HeadingStack()
    for _ in range(200):
        rows = pd.DataFrame({"level": rng.integers(1, 6, 12), "heading": [f"x{i}" for i in range(12)]})
        state = [f"s{i}" for i in range(int(rng.integers(0, 7)))]
        cut, want = int(rng.integers(1, 12)), state
        for level, heading in zip(rows["level"], rows["heading"], strict=True):
            want, _ = fold.step(want, level, heading)
        assert fold.apply(fold.apply(state, fold.summary(rows[:cut])), fold.summary(rows[cut:])) == want
