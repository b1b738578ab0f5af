"""Batched retrieval: dense and lexical streams per question, rank fusion, budgets.

Questions come as a DataFrame, so one job answers many. Vectors meet in tiles: a block of at most about ``MOST_QUESTIONS`` questions
and a column of candidates, dealt by a shuffle; nothing is broadcast or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators import tiles

#: Questions of one tile; every block of them meets all vectors, which a shuffle deals once for each.
MOST_QUESTIONS = 1 << 16


#: Rows of a side that may be broadcast whole.
MOST_BROADCAST = 20_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else unmarked, for the planner to place."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length, as doubles."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``question_id, chunk_id, score, rank``: exact cosine top ``k`` by the score in ``digits`` digits, ties by id.

    ``queries(question_id, q)``, ``vectors(chunk_id, v)``. Every tile gives the best ``k`` of its candidates for each of its
    questions; a window ranks what the tiles of a question give. A vector that is null, zero or of another length has no score and
    comes last.
    """
    blocks = max(1, -(-queries.count() // MOST_QUESTIONS))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, -(-vectors.count() // tiles.COLUMN_ROWS), -(-parts // blocks))
    block, column = F.pmod(F.xxhash64("question_id"), F.lit(blocks)), F.pmod(F.xxhash64("chunk_id"), F.lit(columns))
    asked = queries.select("question_id", "q", F.explode(F.sequence(block * columns, block * columns + columns - 1)).alias("tile"))
    given = vectors.select("chunk_id", "v", F.explode(F.sequence(column, column + (blocks - 1) * columns, F.lit(columns).cast("long"))).alias("tile"))
    return top(tiles.best(asked, given, blocks * columns, k, digits), k)


def top(scored: DataFrame, k: int, key: str = "question_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("chunk_id")))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def rrf(streams: list[tuple[DataFrame, float]], k: int = 60, digits: int | None = None, most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``(question_id, chunk_id, rank)`` streams: one union, one aggregation.

    Also gives ``paths``, the bit set of streams that hold the chunk.
    """
    union = None
    for i, (stream, weight) in enumerate(streams):
        part = stream.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank")).select("question_id", "chunk_id", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"), F.lit(1 << i).alias("bit"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("question_id", "chunk_id").agg(F.sum("part").alias("fusion_score"), F.sum("bit").cast("long").alias("paths"))
    if digits is not None:
        fused = fused.withColumn("fusion_score", F.round("fusion_score", digits))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("fusion_score"), "chunk_id")).cast("long")
    out = fused.withColumn("rank", rank)
    return out if most is None else out.where(F.col("rank") <= most)


def pack_skip(items: Column, budget: int) -> Column:
    """Skip-greedy packing of an ordered array of ``struct<id, tokens>``: what does not fit is skipped, later ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    return F.aggregate(
        items,
        start,
        lambda s, x: F.when(
            s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).alias("used"), F.array_append(s["ids"], x["id"]).alias("ids"))
        ).otherwise(s),
    )


def dense_topk_lists(queries: DataFrame, vectors: DataFrame, k: int, lists: int = 64, recall: float = 0.95) -> DataFrame:
    """Approximate cosine top ``k`` by inverted lists: every vector lies in the list of its nearest centre, a question looks into the nearest few.

    Centres, and how many lists a question needs for ``recall``, are found on the ``tiles.SAMPLE`` vectors of least hash; vectors of a
    sample lie wider apart than all do, so the number errs on the safe side. Large lists are cut into columns.
    """
    sample = vectors.where("v IS NOT NULL").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(tiles.SAMPLE).select("v").toArrow()
    centres, probes = tiles.fitted(sample.column("v"), lists, k, recall)
    placed = tiles.nearest_lists(vectors, "chunk_id", "v", centres, 1)
    columns = max(1, -(-vectors.count() // tiles.COLUMN_ROWS))
    column = F.pmod(F.xxhash64("chunk_id"), F.lit(columns))
    given = placed.select("chunk_id", "v", (F.get("lists", F.lit(0)) * columns + column).alias("tile"))
    spread = F.flatten(F.transform("lists", lambda x: F.sequence(x * columns, x * columns + columns - 1)))
    asked = tiles.nearest_lists(queries, "question_id", "q", centres, probes).select("question_id", "q", F.explode(spread).alias("tile"))
    return top(tiles.best(asked, given, max(1, len(centres)) * columns, k, 6), k).where("score IS NOT NULL")
