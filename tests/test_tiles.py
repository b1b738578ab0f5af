"""Vectors in tiles against plain Python: ties by id, missing and zero vectors, several tiles, recall of inverted lists."""

import numpy as np
import pyarrow as pa

from docweft.operators import retrieve, tiles

SCHEMA = "id bigint, v array<float>"


def frames(spark, rows, every):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.where(f"id % {every} = 0").selectExpr("id AS question_id", "v AS q"), df.selectExpr("id AS chunk_id", "v")


def test_best_of_tiles_with_ties_nulls_and_zeros(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    rows[7] = (7, None)
    rows[10] = (10, [0.0] * 4)
    rows += [(200 + i, [1.0, 2.0, -1.0, 0.5]) for i in range(40)]
    q, v = frames(spark, rows, 10)
    monkeypatch.setattr(retrieve, "MOST_QUESTIONS", 5)
    monkeypatch.setattr(tiles, "GIVEN_SIDE", 16)
    got = {}
    for r in retrieve.dense_topk(q, v, 6).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.chunk_id, r.score))
    known = {i: np.array(x, np.float32).astype(float) for i, x in rows if x is not None and any(x)}
    for i, _ in rows:
        if i % 10:
            continue
        score = {j: round(float(known[i] @ known[j] / np.sqrt((known[i] @ known[i]) * (known[j] @ known[j]))), 6) + 0.0 if i in known and j in known else None for j, _ in rows}
        want = sorted(score, key=lambda j: (score[j] is None, -(score[j] or 0.0), j))[:6]
        assert sorted(got[i]) == [(k + 1, j, score[j]) for k, j in enumerate(want)]


def test_inverted_lists_read_few_and_find_most(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 16)) * 3
    rows = [(i, (middle[i % 20] + rng.normal(size=16)).astype(float).tolist()) for i in range(1500)]
    q, v = frames(spark, rows, 20)
    pairs = lambda df: {(r.question_id, r.chunk_id) for r in df.collect()}
    exact, found = pairs(retrieve.dense_topk(q, v, 10)), pairs(retrieve.dense_topk_lists(q, v, 10, lists=20))
    assert len(exact & found) >= 0.9 * len(exact)
    centres, probes = tiles.fitted(v.select("v").toArrow().column("v"), 20, 10, 0.95)
    assert len(centres) == 20 and probes <= 10


def test_single_precision_only_leaves_out_what_cannot_be_kept():
    """Cosines lie closer together than single precision tells them apart; ids and scores are those of double precision."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    given = base + rng.normal(size=(3000, 64)) * 1e-3 * rng.random((3000, 1))
    given[7], given[2000:2100] = 0, given[:100]
    asked = np.vstack([base + rng.normal(size=(20, 64)) * 1e-3, np.zeros((1, 64))])
    tile = tiles._Asked(30, 6)
    tile.add(np.arange(21), pa.array(asked.tolist()))
    for at in range(0, 3000, 700):
        tile.meet(np.arange(at, min(at + 700, 3000)), pa.array(given[at : at + 700].tolist()))
    assert tile.single.dtype == np.float32
    length = np.linalg.norm(given, axis=1)
    for q in range(20):
        score = np.round(given @ asked[q] / np.where(length > 0, length, 1) / np.linalg.norm(asked[q]), 6)
        score[7] = tiles.NO_SCORE
        want = np.lexsort((np.arange(3000), -score))[:30]
        assert tile.found[q].tolist() == want.tolist() and tile.score[q].tolist() == score[want].tolist()
    assert tile.found[20].tolist() == list(range(30)) and set(tile.score[20]) == {tiles.NO_SCORE}
