"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be copied ``target / source size`` times, a number from 0 to 2 with one fractional part
for the whole source. The fractions are made whole by the pivotal method: two fractions meet, a random transfer makes
one of them 0 or 1 and the other carries the rest, so their sum never changes and every document keeps its expected
number of copies. Meetings form a reduction tree: blocks of a few dozen documents fold first, their one open residual
each goes to the next level, where 32 blocks meet, and so on to one residual per source. Documents of like size share
blocks, so that keeping the sum of copies also keeps the sum of words.

No block of the tree grows with the data: level 0 spreads every source over a number of buckets that follows the row
count, so one source with a third of all rows is spread like any other. Decisions depend on ids, sizes and the seed only,
never on partitioning, so reruns agree.

Defined cases: null text has size 0 and takes 0 words; a null source is a source of its own, last in order; repeated rows
(equal ids, missing ones included) are decided one by one; an empty table gives an empty result; extra columns are ignored by
``plan`` and kept by ``repeat``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.ranks import with_running
from docweft.llm.registry import query
from docweft.llm.words import n_words
from docweft.session import durable, table

#: Weights by source in code-point order, repeating; the share of all words to take; most copies.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Residuals that meet in one block of a level above the first, and documents per block of the first.
FAN_IN = 32
SEED = 20_240_501
NEAR_WHOLE = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target, number`` from ``source, size``; ``number``: place by code point, from 0.

    Water filling in closed form: sources sorted by cap per weight are capped up to the first whose share of what is
    left fits below its cap; that share per weight then holds for all the rest. Works on one row per source, by ranges.
    """
    per = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_name = with_running(per, [F.col("source").asc_nulls_last()], {}).withColumnRenamed("_rank", "number")
    weighed = by_name.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = weighed.agg((share * F.coalesce(F.sum("source_size"), F.lit(0))).alias("total"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("weight")).first()
    order = [F.col("_ratio"), F.col("number")]
    filled = durable(with_running(weighed, order, {"_caps": F.col("_cap"), "_ws": F.col("_w")}).withColumn("_level", (F.lit(float(whole["total"])) - F.col("_caps")) / (F.lit(float(whole["weight"])) - F.col("_ws"))))
    first = filled.where("_ratio > _level").agg(F.min(F.struct("_rank", "_level")).alias("f")).first()["f"]
    if first is None:
        target = F.col("_cap")
    else:
        target = F.when(F.col("_rank") < first["_rank"], F.col("_cap")).otherwise(F.col("_w") * F.lit(first["_level"]))
    return filled.select("source", "source_size", target.alias("target"), "number")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / float(1 << 52)


def _fold(items: Column, level: int) -> Column:
    """Pivotal steps over a block: struct of the open residual ``carry`` and the decided ``out``."""
    item = "struct<tag:bigint,doc_id:bigint,size:bigint,whole:bigint,p:double,handle:bigint>"
    start = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{item}>").alias("out"))

    def put(x: Column, p: Column) -> Column:
        return F.struct(x["tag"].alias("tag"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["whole"].alias("whole"), p.cast("double").alias("p"), x["handle"].alias("handle"))

    def meet(state: Column, x: Column) -> Column:
        a, b = state["carry"], x
        total = a["p"] + b["p"]
        u = _uniform(a["tag"], b["tag"], F.lit(level))
        full = total >= 1.0 - NEAR_WHOLE
        rest = F.greatest(F.lit(0.0), F.when(full, total - 1.0).otherwise(total))
        # Below 1: the winner holds the sum and stays open. From 1 on: the winner takes 1 and is decided.
        a_wins = F.when(full, u * F.greatest(2.0 - total, F.lit(1e-300)) < 1.0 - b["p"]).otherwise(u * total < a["p"])
        a_open = a_wins != full
        settled = F.when(full, F.lit(1.0)).otherwise(F.lit(0.0))
        opened, closed = F.when(a_open, put(a, rest)).otherwise(put(b, rest)), F.when(a_open, put(b, settled)).otherwise(put(a, settled))
        met = F.struct(opened.alias("carry"), F.array_append(state["out"], closed).alias("out"))
        first = F.struct(put(x, x["p"]).alias("carry"), state["out"].alias("out"))
        return F.when(a.isNull(), first).otherwise(met)

    return F.aggregate(items, start, meet)


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, handle`` for ``doc_id, source, size`` and an optional ``handle``.

    Decisions do not depend on the handle, which only tells rows apart. The word counts are written to the shared folder once; all levels of the tree then work on narrow rows.
    """
    handle = (F.col("handle") if "handle" in sizes.columns else F.lit(0)).cast("long").alias("handle")
    sizes = durable(sizes.select("doc_id", "source", F.col("size").cast("long").alias("size"), handle))
    total = sizes.count()
    known = durable(targets(sizes, weights, share, most).withColumnRenamed("number", "_s"))
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round(mean)
    share_of = F.when(F.abs(mean - near) < NEAR_WHOLE, near).otherwise(mean)
    numbered = sizes.join(known, sizes["source"].eqNullSafe(known["source"])).select(
        "_s",
        F.xxhash64(F.lit(SEED), "doc_id", "size", sizes["source"]).alias("tag"),
        "doc_id",
        "size",
        F.floor(share_of).cast("long").alias("whole"),
        (share_of - F.floor(share_of)).alias("p"),
        "handle",
    )
    buckets, levels = 1, 0
    while buckets * FAN_IN < max(1, total // 8):
        buckets, levels = buckets * FAN_IN, levels + 1
    bucket = F.pmod(F.col("tag"), F.lit(buckets))
    like = F.floor(4 * F.log2(F.col("size") + 1.0)).cast("long")
    item = F.struct("tag", "doc_id", "size", "whole", "p", "handle")
    level = numbered.select("_s", like.alias("_like"), bucket.alias("_b"), item.alias("_x"))
    parts = []
    for depth in range(levels + 2):
        keys = ["_s", "_like", "_b"] if depth <= levels else ["_s"]
        if depth <= levels:
            block = F.array_sort(F.collect_list("_x"))
        else:  # neighbours in size meet
            block = F.transform(F.array_sort(F.collect_list(F.struct("_like", "_x"))), lambda y: y["_x"])
        folded = level.groupBy(*keys).agg(_fold(block, depth).alias("_f"))
        parts.append(folded.select("_s", F.explode("_f.out").alias("_x")))
        if depth <= levels:
            level = folded.select("_s", "_like", F.floor(F.col("_b") / FAN_IN).cast("long").alias("_b"), F.col("_f.carry").alias("_x"))
            if depth == levels:
                level = level.drop("_b")
        else:
            last = F.col("_f.carry")
            rounded = F.when(_uniform(last["tag"]) < last["p"] - NEAR_WHOLE, 1.0).otherwise(0.0)
            parts.append(folded.select("_s", last.withField("p", rounded).alias("_x")))
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part)
    return decided.join(known, "_s").select(
        F.col("_x.doc_id").alias("doc_id"),
        F.col("_x.size").alias("size"),
        "source",
        "source_size",
        "target",
        (F.col("_x.whole") + F.round("_x.p").cast("long")).alias("copies"),
        F.col("_x.handle").alias("handle"),
    )


def repeat(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` as many times as the mix takes it, with its own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = durable(docs.select(row, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words(F.col(text)).alias("_n"), F.monotonically_increasing_id().alias("_handle")))
    planned = plan(held.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_n").alias("size"), F.col("_handle").alias("handle")))
    joined = held.join(planned.where("copies > 0").select("handle", "copies"), F.col("_handle") == F.col("handle"))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 150 % mix takes of every document (native DataFrame functions only)."""
    docs = table(spark, sf_dir, "documents")
    mixed = plan(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
