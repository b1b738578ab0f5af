"""Running sums inside keys where one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.session import durable

#: Kinds of sums: how numpy accumulates, how a value is taken back, how Spark adds up.
KINDS = {"sum": (np.add, np.subtract, F.sum), "xor": (np.bitwise_xor, np.bitwise_xor, F.bit_xor)}


def _stepper(key: str, names: list[str], kind: str):
    add, take, _ = KINDS[kind]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, dict.fromkeys(names, np.int64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            segment, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            out = []
            for name in names:
                reached = add.accumulate(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.concatenate([[0], reached[starts[1:] - 1]]).astype(np.int64)
                run = take(reached, base[segment])
                if keys[0] == last:
                    run = np.where(segment == 0, add(run, carried[name]), run)
                carried[name] = run[-1]
                out.append(pa.array(run))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(batch.num_rows, part, dtype=np.int32))], [*batch.schema.names, *[f"_run_{n}" for n in names], "_part"])

    return step


def along(frame: DataFrame, key: str, order: list[Column], sums: dict[str, Column], kind: str = "sum") -> DataFrame:
    """``frame`` with, per name in ``sums``, the sum (or ``xor``) of its whole-number expression over the rows of the same
    ``key`` up to and with each row, in ``order``.

    Rows are dealt by ranges of key and order, so that a hot key lies in many tasks; each streams through its rows once. Keys
    that span tasks, at most one per border, then get what earlier tasks summed: one row per task, which is broadcast. ``key``
    is a long without nulls. The rows are written, so that nothing is dealt twice.
    """
    _, _, spark_sum = KINDS[kind]
    own = [c for c in frame.columns if c not in sums]
    valued = frame.select(*own, *[e.cast("long").alias(n) for n, e in sums.items()])
    dealt = valued.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    wider = valued.schema
    for name in sums:
        wider = wider.add(f"_run_{name}", "long")
    runs = durable(dealt.mapInArrow(_stepper(key, list(sums), kind), wider.add("_part", "integer")))
    borders = runs.groupBy("_part").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).select("_part", F.explode(F.array_distinct(F.array("_a", "_b"))).alias(key))
    spanning = borders.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(key)
    totals = runs.join(F.broadcast(spanning), key, "left_semi").groupBy(key, "_part").agg(*[spark_sum(n).alias(f"_of_{n}") for n in sums])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), *[spark_sum(f"_of_{n}").over(before).alias(f"_from_{n}") for n in sums])
    met = runs.join(F.broadcast(carried), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    whole = lambda n: F.col(f"_run_{n}") + F.coalesce(F.col(f"_from_{n}"), F.lit(0)) if kind == "sum" else F.col(f"_run_{n}").bitwiseXOR(F.coalesce(F.col(f"_from_{n}"), F.lit(0)))
    return met.select(*own, *[whole(n).alias(n) for n in sums])
