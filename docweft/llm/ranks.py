"""Ranks and running sums over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.session import durable

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
IN_PARTITION = 33


def with_running(frame: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``frame`` with ``_rank`` (from 0) and, per name in ``sums``, the sum of its expression over all rows before, in ``order``.

    Rows are dealt into ranges and sorted inside them; one row of totals per range, never more than there are partitions, then
    shifts the running sums of each range. The sorted rows are written, so that ranks stay as they are.
    """
    lined = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_line", F.monotonically_increasing_id())
    lined = durable(lined).withColumn("_part", F.shiftright("_line", IN_PARTITION))
    amounts = {"_rank": F.lit(1).cast("long"), **sums}
    valued = lined.withColumns({f"_of{n}": e for n, e in amounts.items()})
    totals = valued.groupBy("_part").agg(*[F.sum(f"_of{n}").alias(f"_sum{n}") for n in amounts])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("_part").alias("_of_part"), *[F.coalesce(F.sum(f"_sum{n}").over(ahead), F.lit(0)).alias(f"_shift{n}") for n in amounts])
    inside = Window.partitionBy("_part").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    met = valued.join(F.broadcast(shifts), F.col("_part") == F.col("_of_part"))
    running = {n: F.coalesce(F.sum(f"_of{n}").over(inside), F.lit(0)) + F.col(f"_shift{n}") for n in amounts}
    return met.withColumns(running).select(*[F.col(f"`{c}`") for c in frame.columns], *amounts)
