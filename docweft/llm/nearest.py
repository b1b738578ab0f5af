"""Nearest vectors by cosine: a block matrix join over int8 codes with error bounds, then exact scores of what survives.

1. Every vector is scaled to unit length and coded in 8 bits a component. With ``a`` the decoded vector and ``e`` what it lacks,
   a cosine lies within ``|a| |e'| + |e|`` of the decoded product; both lengths are kept with the code.
2. Queries are cut into blocks of at most ``QUERY_BYTES`` of codes and candidates into columns; each block meets each column in one
   *tile*, so codes, not vectors, are sent once per block. A tile holds its queries and streams through its candidates. Products of
   codes are whole numbers, exact in floating-point matrix products.
3. Per query a tile keeps a heap of the ``k`` greatest lower bounds; a pair survives while its upper bound reaches the heap's
   least. Bounds of all tiles of a query then meet, and the ``k``-th greatest lower bound of all prunes once more.
4. Survivors meet their vectors by a join and are scored in double precision, each alone, so that equal vectors score equally.

Of candidates that are the same vector only the ``k`` with the smallest ids can be found, so a vector that a third of all rows
repeat costs a query ``k`` survivors a chunk, never a pair for each row. Nothing is dropped that could be among the nearest:
the result is exact, so recall is 1. A tile whose survivors do not shrink writes them out and goes on.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors meet only those of
as many components; a query's own row is no candidate, but a row that repeats its id or vector is; a row without an id is a
candidate, last among ties, with a null id; queries of equal id are searched each; ``k`` or fewer results, if there are no more
candidates; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from docweft.llm.registry import query
from docweft.llm.shingles import mixed
from docweft.session import durable, release, table

#: Fixed values of the query: results of each, and divisor of its ids.
K = 5
EVERY = 50
#: Bytes of codes in a block of queries, candidates of a column, rows of a product's sides, survivors that a tile holds.
QUERY_BYTES = 4 << 20
COLUMN_ROWS = 1 << 22
SIDE = 2048
HELD = 1 << 20
#: Rounding of the tile's single-precision bounds.
SLACK = np.float32(4e-6)
#: Components up to which products of codes are whole numbers in single precision.
SINGLE = 1024
NO_ID = np.iinfo(np.int64).max
CODED = "row long, vec_id long, is_query boolean, dim int, code binary, scale double, length double, error double, same long, vector array<{}>"
FOUND = "q long, c long, vec_id long, same long, low double, high double"


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by number of components, and their components as doubles (null: not a number)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that squares neither overflow nor vanish; cosines stay exactly what they are."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vector")
        for rows, matrix in _by_length(column):
            if not matrix.shape[1]:
                continue
            good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
            rows, matrix = rows[good], scaled(matrix[good]) if good.any() else matrix[good]
            if not len(rows):
                continue
            unit = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
            scale = np.abs(unit).max(axis=1) / 127
            code = np.rint(unit / scale[:, None]).astype(np.int8)
            near = code * scale[:, None]
            width = matrix.shape[1]
            place = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            same = mixed((mixed((matrix + 0.0).view(np.uint64) + place)).sum(axis=1, dtype=np.uint64)).view(np.int64)
            taken = batch.take(pa.array(rows))
            columns = [taken.column("row"), taken.column("vec_id"), taken.column("is_query"), pa.array(np.full(len(rows), width, dtype=np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale)]
            columns += [pa.array(np.sqrt((near * near).sum(axis=1))), pa.array(np.sqrt(((unit - near) ** 2).sum(axis=1))), pa.array(same), taken.column("vector")]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "is_query", "dim", "code", "scale", "length", "error", "same", "vector"])


def coded(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row`` (a handle), ``vec_id, is_query``, the code with its bounds, ``same`` (equal for equal vectors) and the vector itself, written."""
    element = "float" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "double"
    read = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(f"`{vector}`").cast(f"array<{element}>").alias("vector"))
    return durable(read.where("vector IS NOT NULL").mapInArrow(_code, CODED.format(element)))


class _Block:
    """Queries of one tile with the same number of components, their heaps and survivors."""

    def __init__(self, k: int, dim: int):
        self.k, self.dim, self.kind = k, dim, np.float32 if dim <= SINGLE else np.float64
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.codes: list[np.ndarray] = []
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.ready = False

    def add(self, codes: np.ndarray, row: np.ndarray, *rest: np.ndarray) -> None:
        self.codes.append(codes)
        self.columns.append((row, *rest))

    def _start(self) -> None:
        row, scale, length, error = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        order = np.argsort(row, kind="stable")
        self.codes = np.concatenate(self.codes)[order]
        self.row, self.scale, self.length, self.error = row[order], *(x[order].astype(np.float32) for x in (scale, length, error))
        self.heap = np.full((len(row), self.k), -np.inf, dtype=np.float32)
        self.ready = True

    def meet(self, codes: np.ndarray, row: np.ndarray, vec_id: np.ndarray, same: np.ndarray, scale: np.ndarray, error: np.ndarray) -> None:
        """Survivors among these candidates (at most ``SIDE``) for all queries of the block."""
        if not self.ready:
            self._start()
        right, scale, error = codes.astype(self.kind).T, scale.astype(np.float32), error.astype(np.float32)
        own = np.minimum(np.searchsorted(self.row, row), len(self.row) - 1)
        own = np.where(self.row[own] == row, own, -1)
        for at in range(0, len(self.row), SIDE):
            end = min(at + SIDE, len(self.row))
            product = (self.codes[at:end].astype(self.kind) @ right).astype(np.float32)
            product *= self.scale[at:end, None] * scale
            margin = self.length[at:end, None] * error + (self.error[at:end, None] + SLACK)
            mine = np.flatnonzero((own >= at) & (own < end))
            product[own[mine] - at, mine] = -np.inf
            least = self.heap[at:end, 0]
            if not np.isfinite(least).all() and len(row) >= self.k:
                least = np.maximum(least, np.partition(product - margin, -self.k, axis=1)[:, -self.k])
            q, c = np.nonzero((product + margin >= least[:, None]) & (product > -np.inf))
            if len(q):
                low, high = product[q, c] - margin[q, c], product[q, c] + margin[q, c]
                kept = first_of(self.k, (vec_id[c], same[c], q), 2)
                q, c, low, high = q[kept], c[kept], low[kept], high[kept]
                self._raise(at, end, q, low)
                self.parts.append((q + at, row[c], vec_id[c], same[c], low, high))

    def _raise(self, at: int, end: int, q: np.ndarray, low: np.ndarray) -> None:
        order = np.lexsort((-low, q))
        q, low = q[order], low[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff([*starts, len(q)]))
        best = np.full((end - at, self.k), -np.inf, dtype=np.float32)
        best[q[place < self.k], place[place < self.k]] = low[place < self.k]
        self.heap[at:end] = np.sort(np.concatenate([self.heap[at:end], best], axis=1), axis=1)[:, -self.k :]

    def shrink(self) -> int:
        """Drops survivors that the heaps have passed; how many stay."""
        if self.parts:
            q, row, vec_id, same, low, high = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            held = np.flatnonzero(high >= self.heap[q, 0])
            held = held[first_of(self.k, (vec_id[held], same[held], q[held]), 2)]
            self.parts = [tuple(x[held] for x in (q, row, vec_id, same, low, high))]
        return sum(len(p[0]) for p in self.parts)

    def drain(self) -> Iterator[pa.RecordBatch]:
        for q, row, vec_id, same, low, high in self.parts:
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(self.row[q]), pa.array(row), pa.array(vec_id), pa.array(same), pa.array(low.astype(np.float64)), pa.array(high.astype(np.float64))], ["q", "c", "vec_id", "same", "low", "high"])
        self.parts = []


def first_of(k: int, keys: tuple[np.ndarray, ...], group: int) -> np.ndarray:
    """Indices of the first ``k`` of each group in the order of ``keys`` (last is primary); the last ``group`` keys make a group."""
    order = np.lexsort(keys)
    if not len(order):
        return order
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in keys[-group:]:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    starts = np.flatnonzero(new)
    return np.sort(order[np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)])) < k])


def _tiles(k: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, blocks = None, {}
        for batch in batches:
            column = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "kind", "row", "vec_id", "dim", "scale", "length", "error", "same")}
            codes = batch.column("code")
            new = np.zeros(batch.num_rows, dtype=bool)
            new[:1] = True
            for n in ("tile", "kind", "dim"):
                new[1:] |= column[n][1:] != column[n][:-1]
            cuts = [*np.flatnonzero(new), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if column["tile"][a] != tile:
                    for block in blocks.values():
                        block.shrink()
                        yield from block.drain()
                    tile, blocks = column["tile"][a], {}
                dim = int(column["dim"][a])
                if column["kind"][a] and dim not in blocks:
                    continue
                for i in range(a, b, SIDE):
                    j = min(i + SIDE, b)
                    part = codes.slice(i, j - i)
                    flat = np.frombuffer(b"".join(part.to_pylist()), dtype=np.int8).reshape(-1, dim)
                    of = {n: c[i:j] for n, c in column.items()}
                    if not of["kind"][0]:
                        blocks.setdefault(dim, _Block(k, dim)).add(flat, of["row"], of["scale"], of["length"], of["error"])
                        continue
                    block = blocks[dim]
                    block.meet(flat, of["row"], of["vec_id"], of["same"], of["scale"], of["error"])
                    if sum(len(p[0]) for p in block.parts) > held and block.shrink() > held // 2:
                        yield from block.drain()
        for block in blocks.values():
            block.shrink()
            yield from block.drain()

    return run


def survivors(codes: DataFrame, k: int) -> DataFrame:
    """``q, c, vec_id, same, low, high``: pairs of handles whose bounds let them be among the query's nearest in their tile."""
    rows, queries, dim = codes.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max("dim")).first()
    blocks = max(1, -(-queries * (dim or 1) // QUERY_BYTES))
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(-(-rows // COLUMN_ROWS), -(-parts // blocks), 1)
    lean = codes.select("row", F.coalesce("vec_id", F.lit(int(NO_ID))).alias("vec_id"), "is_query", "dim", "code", "scale", "length", "error", "same")
    block, column = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit(2)), F.lit(columns))
    asked = lean.where("is_query").withColumn("tile", F.explode(F.sequence(block * columns, block * columns + columns - 1))).withColumn("kind", F.lit(0))
    given = lean.withColumn("tile", F.explode(F.sequence(column, column + (blocks - 1) * columns, F.lit(columns).cast("long")))).withColumn("kind", F.lit(1))
    dealt = asked.unionByName(given).drop("is_query").repartitionById(blocks * columns, F.col("tile").cast("int")).sortWithinPartitions("tile", "kind", "dim")
    return dealt.mapInArrow(_tiles(k, HELD), FOUND)


def pruned(found: DataFrame, k: int) -> DataFrame:
    """``q, c`` that bounds of all tiles leave."""
    met = found.repartition("q")
    copies = met.withColumn("_copy", F.row_number().over(Window.partitionBy("q", "same").orderBy("vec_id", "c"))).where(F.col("_copy") <= k)
    lows = copies.withColumn("_place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"))))
    least = F.coalesce(F.max(F.when(F.col("_place") == k, F.col("low"))).over(Window.partitionBy("q")), F.lit(float("-inf")))
    return lows.withColumn("_least", least).where("high >= _least").select("q", "c")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for (rows, left), (_, right) in zip(_by_length(batch.column("left")), _by_length(batch.column("right")), strict=True):
            left, right = scaled(left), scaled(right)
            score[rows] = np.clip((left * right).sum(axis=1) / np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1)), -1, 1)
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("query_id"), batch.column("vec_id"), pa.array(score)], ["q", "query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query``, the ``k`` other rows of greatest cosine."""
    codes = coded(vectors, is_query, vec_id, vector)
    left = durable(pruned(survivors(codes, k), k))
    given = codes.select(F.col("row").alias("c"), "vec_id", F.col("vector").alias("right"))
    asked = codes.where("is_query").select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("vector").alias("left"))
    scored = left.join(given, "c").join(asked, "q").select("q", "query_id", "vec_id", "left", "right").mapInArrow(_scores, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    out = durable(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    release(codes, left)
    return out


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score,
  row_number() OVER (PARTITION BY q.r ORDER BY list_cosine_similarity(q.e, c.e) DESC, c.vec_id)::INT AS rank FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0) WHERE rank <= 5
"""


@query("op11_nearest", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for every embedding whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
