"""Nearest vectors in tiles: questions and candidates of one tile meet in matrix products, each question keeps its best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of a column on average, rows of a product's sides.
COLUMN_ROWS, ASKED_SIDE, GIVEN_SIDE = 1 << 18, 1024, 4096
#: Pairs that are scored at a time.
SCORED = 1 << 17
#: Vectors on which inverted lists are fitted, and those of them that ask there; rounds of the fit.
SAMPLE, SAMPLE_ASKED, ROUNDS = 8192, 256, 8
#: Stands for a missing id, and for a score that does not exist.
NO_ID, NO_SCORE = np.iinfo(np.int64).max, -9.0


def units(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column at unit length, and which are such: not null, not zero, finite, of ``dim`` components (default: the first row's)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(sizes[sizes > 0][0]) if (sizes > 0).any() else 0
    good = sizes == dim
    matrix = np.zeros((len(sizes), dim))
    if dim and good.any():
        matrix[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    length = np.sqrt((matrix * matrix).sum(axis=1))
    good &= np.isfinite(length) & (length > 0)
    matrix[~good] = 0
    matrix[good] /= length[good, None]
    return matrix, good


class _Asked:
    """Questions of one tile with their best ``k`` so far, best first."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits, self.half = k, digits, 0.5 * 10.0**-digits
        self.ids: list[np.ndarray] = []
        self.vectors: list[pa.Array] = []
        self.matrix = None

    def add(self, ids: np.ndarray, vectors: pa.Array) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def start(self) -> None:
        if self.matrix is None:
            self.ids = np.concatenate(self.ids)
            self.matrix, self.good = units(pa.chunked_array(self.vectors))
            self.single = self.matrix.astype(np.float32)
            self.vectors = []
            self.score = np.full((len(self.ids), self.k), -np.inf)
            self.found = np.full((len(self.ids), self.k), NO_ID)

    def meet(self, ids: np.ndarray, vectors: pa.Array) -> None:
        """Candidates come in the order of their ids, so one that ties with the last kept loses.

        Products in single precision, off by less than ``slack``, leave out what cannot be kept; the others are scored in double precision.
        """
        self.start()
        right, good = units(vectors, self.matrix.shape[1])
        single, slack = right.astype(np.float32).T, (self.matrix.shape[1] + 8) * 2.0**-24
        for at in range(0, len(self.ids), ASKED_SIDE):
            end = min(at + ASKED_SIDE, len(self.ids))
            product = self.single[at:end] @ single
            if not good.all():
                product[:, ~good] = NO_SCORE
            if not self.good[at:end].all():
                product[~self.good[at:end]] = NO_SCORE
            least = self.score[at:end, -1]
            bar = least + 0.99 * self.half
            if not np.isfinite(least).all() and len(ids) >= self.k:
                bar = np.maximum(bar, np.partition(product, -self.k, axis=1)[:, -self.k].astype(np.float64) - 2.02 * self.half - slack)
            q, c = np.divmod(np.flatnonzero(product >= (bar - 2 * slack).astype(np.float32)[:, None]), len(ids))
            for i in range(0, len(q), SCORED):
                self._score(q[i : i + SCORED] + at, c[i : i + SCORED], right, good, ids)

    def _score(self, q: np.ndarray, c: np.ndarray, right: np.ndarray, good: np.ndarray, ids: np.ndarray) -> None:
        exact = np.where(self.good[q] & good[c], np.einsum("ij,ij->i", self.matrix[q], right[c]), NO_SCORE)
        score = np.round(exact, self.digits) + 0.0
        better = score > self.score[q, -1]
        if better.any():
            self._keep(q[better], score[better], ids[c[better]])

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(q)
        q = np.concatenate([np.repeat(rows, self.k), q])
        score = np.concatenate([self.score[rows].ravel(), score])
        ids = np.concatenate([self.found[rows].ravel(), ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff([*starts, len(q)]))
        kept = place < self.k
        self.score[q[kept], place[kept]] = score[kept]
        self.found[q[kept], place[kept]] = ids[kept]

    def drain(self) -> Iterator[pa.RecordBatch]:
        self.start()
        rows, places = np.nonzero(self.score > -np.inf)
        for at in range(0, len(rows), 1 << 16):
            r, p = rows[at : at + (1 << 16)], places[at : at + (1 << 16)]
            score = self.score[r, p]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.found[r, p]), pa.array(score, mask=score == NO_SCORE)], ["question_id", "chunk_id", "score"])


def _met(k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked = None, None
        for batch in batches:
            tiles, kinds, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "kind", "id"))
            cuts = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if tiles[a] != tile:
                    if asked is not None:
                        yield from asked.drain()
                    tile, asked = tiles[a], None
                if kinds[a] == 0:
                    asked = asked or _Asked(k, digits)
                    asked.add(ids[a:b], batch.column("v").slice(a, b - a))
                elif asked is not None:
                    for i in range(a, b, GIVEN_SIDE):
                        asked.meet(ids[i : min(i + GIVEN_SIDE, b)], batch.column("v").slice(i, min(i + GIVEN_SIDE, b) - i))
        if asked is not None:
            yield from asked.drain()

    return run


def best(asked: DataFrame, given: DataFrame, tiles: int, k: int, digits: int) -> DataFrame:
    """``question_id, chunk_id, score``: in every tile, the ``k`` candidates of greatest cosine of each question, ties by id.

    ``asked(question_id, q, tile)``, ``given(chunk_id, v, tile)``; tiles count from 0.
    """
    kinds = {asked.schema["q"].dataType.simpleString(), given.schema["v"].dataType.simpleString()}
    kind = kinds.pop() if kinds == {"array<float>"} else "array<double>"
    row = lambda df, key, v, n: df.select(F.col("tile").cast("int").alias("tile"), F.lit(n).alias("kind"), F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(v).cast(kind).alias("v"))
    dealt = row(asked, "question_id", "q", 0).unionByName(row(given, "chunk_id", "v", 1)).repartitionById(tiles, F.col("tile")).sortWithinPartitions("tile", "kind", "id")
    met = dealt.mapInArrow(_met(k, digits), "question_id long, chunk_id long, score double")
    back = lambda name, df: F.when(F.col(name) != int(NO_ID), F.col(name)).cast(df.schema[name].dataType).alias(name)
    return met.select(back("question_id", asked), back("chunk_id", given), "score")


def fitted(column: pa.Array, lists: int, k: int, recall: float) -> tuple[np.ndarray, int]:
    """Centres of at most ``lists`` lists by spherical k-means, and in how many of them a question finds ``recall`` of its nearest ``k``."""
    matrix, good = units(column)
    matrix = np.unique(matrix[good], axis=0)
    rng = np.random.default_rng(7)
    matrix = matrix[rng.permutation(len(matrix))]
    lists = min(lists, len(matrix))
    if not lists:
        return np.zeros((0, matrix.shape[1])), 0
    centres = matrix[:lists].copy()
    for _ in range(ROUNDS):
        own = (matrix @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, matrix)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    own = (matrix @ centres.T).argmax(axis=1)
    asked = matrix[:SAMPLE_ASKED]
    nearest = np.argsort(-(asked @ matrix.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(lists), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[nearest], axis=1).ravel()) + 1
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def nearest_lists(rows: DataFrame, key: str, v: str, centres: np.ndarray, most: int) -> DataFrame:
    """``key, v, lists``: the ``most`` nearest centres of every row; rows without direction, or of another length, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, good = units(batch.column(v), centres.shape[1])
            near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :most]
            lists = pa.array([x if g else [] for x, g in zip(near, good, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(v), lists], [key, v, "lists"])

    types = {n: rows.schema[n].dataType.simpleString() for n in (key, v)}
    return rows.select(key, v).mapInArrow(run, f"{key} {types[key]}, {v} {types[v]}, lists array<long>").where(F.size("lists") > 0)
