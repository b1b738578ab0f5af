"""Scores of extraction, evidence and ratings over frames of the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of one task, about.
TASK_UNITS = 1 << 19
#: Candidates that a reranker sees at most.
MOST_RERANKED = 32


def flat(text: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def kept_share(pieces: Column, text: Column) -> Column:
    """Share of ``pieces`` that ``text`` contains, both flattened; 1.0 if there are none."""
    whole = flat(text)
    held = F.filter(pieces, lambda p: whole.contains(flat(p)))
    return F.when(F.size(pieces) == 0, F.lit(1.0)).otherwise(F.size(held) / F.size(pieces))


def ordered_share(items: str, text: str) -> Column:
    """Share of the items of column ``items`` found in column ``text`` one after another; 1.0 if there are none."""
    step = f"aggregate({items}, named_struct('at', 1, 'n', 0), (s, x) -> if(locate(x, {text}, s.at) > 0, named_struct('at', locate(x, {text}, s.at) + length(x), 'n', s.n + 1), s)).n"
    return F.when(F.size(items) == 0, F.lit(1.0)).otherwise(F.expr(step) / F.size(items))


def table_match(expected: Column, actual: Column) -> list[Column]:
    """``row_score, column_score, header`` of two arrays of rows, each an array of cells."""
    width = lambda rows: F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    share = lambda a, e: F.when(e == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), a / e))
    head = lambda rows: F.transform(F.get(rows, F.lit(0)), flat)
    return [share(F.size(actual), F.size(expected)).alias("row_score"), share(width(actual), width(expected)).alias("column_score"), head(expected).eqNullSafe(head(actual)).alias("header")]


def review_summary(reviews: DataFrame) -> DataFrame:
    """Mean score and share of marks per variant and marks, open reviews, and query reviews one reviewer gave twice.

    ``reviews(variant, marks, query_id, reviewer, score)``; a null score is pending.
    """
    per = reviews.groupBy("variant", "marks", "query_id", "reviewer").agg(F.count(F.lit(1)).alias("k"), F.count("score").alias("done"), F.sum("score").alias("total"))
    out = per.groupBy("variant", "marks").agg(F.sum("k").alias("reviews"), F.sum("done").alias("_done"), F.sum("total").alias("_total"), F.count_if(F.col("k") > 1).alias("duplicates"))
    mean = F.col("_total") / F.col("_done")
    return out.select("variant", "marks", "reviews", (F.col("reviews") - F.col("_done")).alias("pending"), "duplicates", F.round(mean, 6).alias("mean_score"), F.round(mean / F.col("marks"), 6).alias("fraction"))


def dual_rater(reviews: DataFrame) -> DataFrame:
    """``variant, questions, nhrs``: mean share of marks over questions with exactly two raters."""
    scored = reviews.where("score IS NOT NULL")
    per = scored.groupBy("variant", "query_id").agg(F.count_distinct("reviewer").alias("_n"), F.avg(F.col("score") / F.col("marks")).alias("_s")).where("_n = 2")
    return per.groupBy("variant").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("_s"), 6).alias("nhrs"))


def evidence_units(units: DataFrame, spans: DataFrame) -> DataFrame:
    """``question_id, units, covered, rer, ect``: units of which one alternative is wholly retrieved, and covered units per 1000 tokens.

    ``units(question_id, unit, alternative, document, start, end)``: an alternative needs all of its spans;
    ``spans(question_id, document, lo, hi, tokens)``: what was retrieved.
    """
    # A unit is covered if, of the spans that begin at or before its start, the greatest end reaches its own: no pairs are made.
    given = spans.where("lo IS NOT NULL AND hi IS NOT NULL").select("question_id", "document", F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.col("hi").alias("_to"), F.lit(None).cast(units.schema["unit"].dataType).alias("unit"), F.lit(None).cast(units.schema["alternative"].dataType).alias("alternative"))
    asked = units.select("question_id", "document", F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.col("end").alias("_to"), "unit", "alternative")
    dealt = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.count() // TASK_UNITS)
    placed = asked.unionByName(given).repartition(dealt, "question_id")
    so_far = Window.partitionBy("question_id", "document").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = placed.withColumn("_hi", F.max(F.when(F.col("_kind") == 0, F.col("_to"))).over(so_far)).where("_kind = 1")
    held = F.coalesce((F.col("_to") <= F.col("_hi")) & F.col("_at").isNotNull() & F.col("question_id").isNotNull() & F.col("document").isNotNull(), F.lit(False))
    whole = reach.groupBy("question_id", "unit", "alternative").agg(F.bool_and(held).alias("_in")).groupBy("question_id", "unit").agg(F.bool_or("_in").alias("_in"))
    per = whole.groupBy("question_id").agg(F.count(F.lit(1)).alias("units"), F.count_if("_in").alias("covered"))
    cost = spans.groupBy("question_id").agg(F.sum("tokens").alias("_t"))
    return per.join(cost, "question_id", "left").select("question_id", "units", "covered", F.round(F.col("covered") / F.col("units"), 6).alias("rer"), F.round(F.when(F.col("_t") > 0, F.col("covered") * 1000.0 / F.col("_t")), 6).alias("ect"))


def rerank(candidates: DataFrame, score: Column, most: int = MOST_RERANKED) -> DataFrame:
    """``question_id, chunk_id, place``: the first ``most`` different candidates by a model's ``score``; ties and missing scores keep the order of ``rank``."""
    once = candidates.withColumn("_score", score).groupBy("question_id", "chunk_id").agg(F.min(F.struct("rank", "_score")).alias("_b")).select("question_id", "chunk_id", "_b.rank", "_b._score")
    first = once.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id"))).where(F.col("_r") <= most)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc_nulls_last("_score"), "_r"))
    return first.select("question_id", "chunk_id", place.cast("long").alias("place"))


def contained(texts: DataFrame, items: DataFrame, gram: int = 3) -> DataFrame:
    """``text_id, item_id`` of every item that a text contains as a substring. ``texts(text_id, text)``, ``items(item_id, item)``.

    A substring may begin and end inside a word, but its inner words are whole words of the text. Items meet the texts by a
    hash of their second to fourth words against every run of three words, then ``contains`` decides. Items of fewer than five
    words have no such run: every text is probed for them, in blocks of about a thousand items.
    """
    words = lambda t: F.split(t, "[ \\n]+")
    known = items.where(F.col("item").isNotNull()).withColumn("_w", words(F.col("item")))
    long = known.where(F.size("_w") >= gram + 2).select("item_id", "item", F.xxhash64(*[F.get("_w", F.lit(k + 1)) for k in range(gram)]).alias("_g"))
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - gram), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(gram)]))
    split = texts.where(F.col("text").isNotNull()).withColumn("_w", words(F.col("text")))
    grams = split.where(F.size("_w") >= gram).select("text_id", F.explode(F.array_distinct(runs)).alias("_g"))
    pairs = grams.join(long.select("item_id", "_g"), "_g").select("text_id", "item_id").distinct()
    met = pairs.join(texts, "text_id").join(long.select("item_id", "item"), "item_id").where(F.col("text").contains(F.col("item"))).select("text_id", "item_id")
    short = known.where(F.size("_w") < gram + 2).select("item_id", "item")
    blocks = -(-short.count() // 1000)
    for b in range(blocks):
        some = F.broadcast(short.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b))
        met = met.unionByName(texts.join(some, F.col("text").contains(F.col("item"))).select("text_id", "item_id"))
    return met
