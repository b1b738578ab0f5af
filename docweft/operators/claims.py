"""Claims against evidence blocks through an inverted index: support, stated citations, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.retrieve import MOST_BROADCAST, small
from docweft.session import durable, release

#: Share of a claim's words that a supporting block holds, without and with numbers in the claim.
SUPPORT, NUMERIC_SUPPORT = 0.60, 0.45
#: Rows that may go to every task: words of claims, ids of blocks, whole claims.
MOST_TERMS, MOST_BLOCKS, MOST_KNOWN = 1 << 18, 1 << 22, MOST_BROADCAST


def threshold(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.lit(NUMERIC_SUPPORT)).otherwise(F.lit(SUPPORT))


def attribute(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """``claim_id, block_id, ratio`` of every supporting block.

    ``claims(claim_id, tokens, numbers)`` and ``blocks(block_id, tokens, numbers)`` hold arrays of distinct strings. A block
    supports a claim if it holds the threshold's share of its words and all of its numbers. A claim of n words that needs m of
    them shares one of its n - m + 1 rarest words with every supporting block, so only those meet the index; frequent words
    are counted but never joined unless a claim has nothing rarer. Claims that are counted and found few go to every task, and a block is
    judged where it is read, at the first rare word that it shares with a claim: no pair is written or shuffled. Of more claims, pairs meet
    by shuffles.
    """
    known = claims.where(F.size("tokens") > 0).withColumn("_need", F.ceil(F.size("tokens") * threshold(F.col("numbers")) - 1e-9))
    terms = known.select("claim_id", "_need", F.size("tokens").alias("_n"), F.explode("tokens").alias("token"))
    blocks = durable(blocks)  # two or three steps read it
    postings = blocks.select("block_id", F.explode("tokens").alias("token"))
    counts = postings.join(small(terms.select("token").distinct(), MOST_TERMS), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    order = Window.partitionBy("claim_id").orderBy("_df", "token")
    rare = durable(terms.join(counts, "token", "left").withColumn("_r", F.row_number().over(order.orderBy(F.coalesce("_df", F.lit(0)), "token"))).where("_r <= _n - _need + 1 AND _df IS NOT NULL").select("claim_id", "token"))
    shared = F.size(F.array_intersect("tokens", "_bt"))
    supported = (shared >= F.col("_need")) & (F.size(F.array_except("numbers", "_bn")) == 0)
    held = blocks.select("block_id", F.col("tokens").alias("_bt"), F.col("numbers").alias("_bn"))
    if known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN and rare.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        told = known.join(rare.groupBy("claim_id").agg(F.collect_list("token").alias("_rare")), "claim_id")
        met = held.withColumn("token", F.explode("_bt")).join(F.broadcast(rare), "token").join(F.broadcast(told), "claim_id")
        met = met.where(supported & (F.get(F.array_intersect("_rare", "_bt"), F.lit(0)) == F.col("token")))
    else:
        pairs = durable(postings.join(small(rare, MOST_TERMS), "token").select("claim_id", "block_id").distinct())
        held = held.join(small(pairs.select("block_id").distinct(), MOST_BLOCKS), "block_id", "left_semi")
        met = pairs.join(held, "block_id").join(small(known, MOST_KNOWN), "claim_id").where(supported)
    found = durable(met.select("claim_id", "block_id", F.round(shared / F.size("tokens"), 6).alias("ratio")))
    release(blocks)
    return found


def evidence(found: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``key, block, content`` of ``found(key, block)``, written; of ``blocks(block, content)`` only those found are shuffled, if their ids can go to every task."""
    held = blocks.join(small(found.select("block").distinct(), MOST_BLOCKS), "block", "left_semi")
    return durable(found.join(held, "block").select(key, "block", "content"))


def check(claims: DataFrame, attributed: DataFrame) -> DataFrame:
    """``claim_id, supporting, best, state``: SUPPORTED, MISCITED (a stated block of ``claims.stated`` does not support) or UNSUPPORTED."""
    found = attributed.groupBy("claim_id").agg(F.count(F.lit(1)).alias("supporting"), F.max("ratio").alias("best"))
    wrong = claims.select("claim_id", F.explode("stated").alias("block_id")).join(attributed.select("claim_id", "block_id"), ["claim_id", "block_id"], "left_anti").select("claim_id").distinct().withColumn("_wrong", F.lit(True))
    state = F.when(F.col("best").isNull(), "UNSUPPORTED").when(F.col("_wrong"), "MISCITED").otherwise("SUPPORTED")
    return claims.select("claim_id").join(found, "claim_id", "left").join(wrong, "claim_id", "left").select("claim_id", F.coalesce("supporting", F.lit(0)).cast("long").alias("supporting"), "best", state.alias("state"))


def verify(checked: DataFrame, answer: Column) -> DataFrame:
    """``answer_id, claims, supported, citation_accuracy, verdict`` of answers, whose claims share ``answer``."""
    out = checked.groupBy(answer.alias("answer_id")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("state") != "UNSUPPORTED").alias("supported"), F.count_if(F.col("state") == "SUPPORTED").alias("_right"))
    verdict = F.when(F.col("supported") == F.col("claims"), "VERIFIED").when(F.col("supported") > 0, "PARTIAL").otherwise("UNSUPPORTED")
    return out.select("answer_id", "claims", "supported", F.round(F.col("_right") / F.col("claims"), 6).alias("citation_accuracy"), verdict.alias("verdict"))
