"""Folds along a document whose steps depend on one another, for documents larger than a task.

A fold's step is a function of its state, and a block of steps is one too. Where the states are few (entries of a heading stack, units
used of a budget), a block has a *summary*: its result for each state it may begin with. Rows are dealt by ranges of document and place;
documents that span ranges, at most one per border, get summaries per range, which are composed in order into the state that each
range begins with. Every range then runs its own rows, streaming, from that state. No document is gathered into a row or a task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.session import durable


class HeadingStack:
    """State: the path so far; a heading of level ``k`` keeps the first ``k - 1`` entries and adds itself."""

    columns = ("level", "heading")
    out = "path string"

    def start(self) -> list:
        return []

    def step(self, path: list, level: int, heading: str) -> tuple[list, str]:
        path = [*path[: max(level - 1, 0)], heading]
        return path, " > ".join(path)

    def summary(self, rows: pd.DataFrame) -> list:
        """For each number of entries to begin with: how many of them stay, and what follows. Beyond the highest level it is the same."""
        found = []
        for entries in range(int(rows["level"].max())):
            path: list = list(range(entries))
            for level, heading in zip(rows["level"], rows["heading"], strict=True):
                path = [*path[: max(level - 1, 0)], heading]
            kept = sum(isinstance(x, int) for x in path)
            found.append((kept, path[kept:]))
        return found

    def apply(self, path: list, summary: list) -> list:
        kept, more = summary[min(len(path), len(summary) - 1)]
        return [*path[:kept], *more]


class SkipPacking:
    """State: units used of a budget; a row that does not fit is left out, later ones may fit."""

    columns = ("tokens",)
    out = "used long, included boolean"

    def __init__(self, budget: int):
        self.budget = budget

    def start(self) -> int:
        return 0

    def step(self, used: int, tokens: int) -> tuple[int, tuple[int, bool]]:
        fits = used + tokens <= self.budget
        used = used + tokens if fits else used
        return used, (used, fits)

    def summary(self, rows: pd.DataFrame) -> list:
        used = np.arange(self.budget + 1)
        for tokens in rows["tokens"]:
            used = np.where(used + tokens <= self.budget, used + tokens, used)
        return used.tolist()

    def apply(self, used: int, summary: list) -> int:
        return summary[used]


def _run(fold, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [c.split()[0] for c in fold.out.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, fold.start()
        for frame in frames:
            said = []
            for document, part, entry, *values in zip(frame[key], frame["_part"], frame["_entry"], *(frame[c] for c in fold.columns), strict=True):
                if at != (document, part):
                    at, state = (document, part), fold.start() if entry is None else json.loads(entry)
                state, told = fold.step(state, *values)
                said.append(told if isinstance(told, tuple) else (told,))
            yield pd.concat([frame[[key, "_id"]], pd.DataFrame(said, columns=names, index=frame.index)], axis=1)

    return run


def along_documents(rows: DataFrame, fold, key: str, order: str, row_id: str) -> DataFrame:
    """``key``, ``row_id`` and the fold's output for every row of ``rows``, in ``order`` within each ``key`` (a long without nulls)."""
    needed = rows.select(F.col(key).cast("long").alias(key), F.col(order).alias("_order"), F.col(row_id).alias("_id"), *fold.columns)
    lined = durable(needed.repartitionByRange(key, "_order", "_id").sortWithinPartitions(key, "_order", "_id").withColumn("_part", F.spark_partition_id()))
    borders = lined.groupBy("_part").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).select("_part", F.explode(F.array_distinct(F.array("_a", "_b"))).alias(key))
    spanning = borders.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(key)

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_order", "_id"])
        return pd.DataFrame({key: group[key][:1], "_part": group["_part"][:1], "_summary": [json.dumps(fold.summary(group))]})

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        state, out = fold.start(), []
        for part, summary in sorted(zip(group["_part"], group["_summary"], strict=True)):
            out.append((group[key].iloc[0], part, json.dumps(state)))
            state = fold.apply(state, json.loads(summary))
        return pd.DataFrame(out, columns=[key, "_part", "_entry"])

    summaries = lined.join(F.broadcast(spanning), key, "left_semi").groupBy(key, "_part").applyInPandas(summarise, f"{key} long, _part int, _summary string")
    begins = summaries.groupBy(key).applyInPandas(entries, f"{key} long, _part int, _entry string")
    dealt = lined.join(F.broadcast(begins), [key, "_part"], "left").repartition(key, "_part").sortWithinPartitions(key, "_part", "_order", "_id")
    kind = dict(rows.dtypes)[row_id]
    return dealt.select(key, "_part", "_entry", "_id", *fold.columns).mapInPandas(_run(fold, key), f"{key} long, _id {kind}, {fold.out}").withColumnRenamed("_id", row_id)
