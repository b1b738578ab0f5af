"""Near-duplicate short texts by the ratio of matching characters, without comparing all pairs.

The ratio ``2 M / (|a| + |b|)`` of matched characters cannot exceed the one of the texts' *bags* of characters. A bag's elements are
(character, n-th occurrence). Two bags that share enough for the threshold share one of the rarest elements of each: those of the
*prefix*, what is left after the overlap that the least admissible partner would need. So only prefixes meet in an equi-join, the
bags' exact overlap thins the pairs, and the matcher itself sees what remains. No pair at the threshold is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docweft.session import durable


@F.pandas_udf(DoubleType())
def matched_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of each pair."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def candidates(texts: DataFrame, least: float) -> DataFrame:
    """``a, b`` (``a < b``) of ``texts(id, q)`` whose bags of characters reach the ratio ``least``."""
    chars = texts.select("id", F.length("q").alias("n"), F.explode(F.filter(F.split("q", ""), lambda x: x != "")).alias("ch"))
    bags = chars.groupBy("id", "n", "ch").agg(F.count(F.lit(1)).alias("k")).select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat("ch", i.cast("string")))).alias("e"))
    bags = durable(bags)
    rarity = bags.groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "e")
    needs = F.ceil(F.col("n") * (least / (2 - least)) - 1e-9)
    prefix = durable(bags.join(rarity, "e").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("n") - needs + 1).select("id", "n", "e"))
    left, right = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "e"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "e")
    sizes = (F.least("na", "nb") >= F.greatest("na", "nb") * (least / (2 - least)) - 1e-9) & (F.col("a") < F.col("b"))
    met = left.join(right, "e").where(sizes).select("a", "b", "na", "nb").distinct()
    whole = bags.groupBy("id").agg(F.collect_list("e").alias("bag"))
    both = met.join(whole.select(F.col("id").alias("a"), F.col("bag").alias("_x")), "a").join(whole.select(F.col("id").alias("b"), F.col("bag").alias("_y")), "b")
    return both.where(2 * F.size(F.array_intersect("_x", "_y")) >= least * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")


def near_pairs(texts: DataFrame, least: float = 0.85, pattern: float = 0.95) -> DataFrame:
    """``a, b, ratio, kind`` of distinct lower-cased ``texts(id, q)``; equal texts are one, with the smallest id; equality is no near pair."""
    own = durable(texts.where("q <> ''").groupBy(F.lower("q").alias("q")).agg(F.min("id").alias("id")))
    pairs = candidates(own, least).join(own.select(F.col("id").alias("a"), F.col("q").alias("_p")), "a").join(own.select(F.col("id").alias("b"), F.col("q").alias("_q")), "b")
    scored = pairs.withColumn("_s", matched_ratio("_p", "_q")).where((F.col("_s") >= least) & (F.col("_s") < 1))
    return scored.select("a", "b", F.round("_s", 3).alias("ratio"), F.when(F.col("_s") >= pattern, "DUPLICATE_PATTERN").otherwise("LEGITIMATE_VARIATION").alias("kind"))
