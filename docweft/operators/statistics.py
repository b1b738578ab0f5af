"""Rank statistics, curves and intervals as window expressions, grouped by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.retrieve import small


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def value_ranks(frame: DataFrame, value: str, by: list[str], name: str = "avg_rank", weight: str | None = None) -> DataFrame:
    """One row per group and distinct value: its ``average_rank``. Windows see distinct values only; ``weight`` counts rows."""
    counts = frame.groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, value, (F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2).alias(name))


def with_average_rank(frame: DataFrame, value: str, by: list[str], name: str = "avg_rank", weight: str | None = None) -> DataFrame:
    """``frame`` with the average rank of ``value`` in its group; few distinct values go to every task, many are joined."""
    ranks = small(value_ranks(frame, value, by, name, weight).withColumnsRenamed({k: f"_r_{k}" for k in (*by, value)}))
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in (*by, value)]
    return frame.join(ranks, same).drop(*[f"_r_{k}" for k in (*by, value)])


def spearman(frame: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """``rho`` per group: the correlation of average ranks, from counts of (a, b) pairs; ranks are centred on their mean ``(n + 1) / 2``."""
    pairs = frame.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_w"))
    ranked = with_average_rank(with_average_rank(pairs, a, by, "_a", "_w"), b, by, "_b", "_w")
    sizes = pairs.groupBy(*by).agg(((F.sum("_w") + 1) / 2).alias("_mean")).withColumnsRenamed({k: f"_s_{k}" for k in by})
    met = ranked.join(small(sizes), [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in by])
    x, y, w = F.col("_a") - F.col("_mean"), F.col("_b") - F.col("_mean"), F.col("_w")
    return met.groupBy(*by).agg(F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y))).alias("rho"))


def auc(frame: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """``roc_auc`` and Mann-Whitney ``u`` per group.

    Reduced to one row per (group, score) first, so the window sees distinct scores only.
    """
    counts = frame.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_r", F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("_p") * F.col("_r")).alias("_s"), F.sum("_p").alias("pos"), F.sum(F.col("_n") - F.col("_p")).alias("neg"))
    u = F.col("_s") - F.col("pos") * (F.col("pos") + 1) / 2
    return sums.select(*by, u.alias("u"), F.when((F.col("pos") > 0) & (F.col("neg") > 0), u / (F.col("pos") * F.col("neg"))).alias("roc_auc"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; null without trials."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)


def ir_metrics(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Recall, precision over the retrieved, hit rate, reciprocal rank and nDCG at ``k`` per question, in one aggregation.

    ``ranked(question_id, rank, gold)``; all gold items are in the list.
    """
    top, gold, r = F.col("rank") <= k, F.col("gold"), F.col("rank")
    per = ranked.groupBy("question_id").agg(
        F.count_if(gold).alias("_g"), F.count_if(top).alias("_t"), F.count_if(top & gold).alias("_h"), F.min(F.when(gold, r)).alias("_f"), F.sum(F.when(top & gold, 1 / F.log2(r + 1.0)).otherwise(0.0)).alias("_d")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("_g", F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.col("_g") > 0
    return per.select(
        "question_id",
        F.round(F.when(some, F.col("_h") / F.col("_g")).otherwise(0.0), 6).alias("recall"),
        F.round(F.when(F.col("_t") > 0, F.col("_h") / F.col("_t")).otherwise(0.0), 6).alias("precision"),
        (F.col("_h") > 0).alias("hit"),
        F.round(F.coalesce(1 / F.col("_f"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(some, F.col("_d") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )
