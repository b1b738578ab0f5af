"""Answer spans: the best pair of start and end by a sliding window, and the longest run of new words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T

#: Tokens of a span at most.
LONGEST = 30


def joint_span(tokens: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``question_id, start_at, end_at, total, answer`` of ``tokens(question_id, i, token, start, end)``.

    Behind every end stands the best start of the ``longest`` tokens up to it, a range frame over one window instead of a join of
    starts with ends; the best end then decides. Equal totals go to the earlier start, then end. The words of the span come back.
    """
    reach = Window.partitionBy("question_id").orderBy("i").rangeBetween(-(longest - 1), 0)
    ends = tokens.withColumn("_s", F.max(F.struct("start", (-F.col("i")).alias("_i"))).over(reach)).withColumn("_span", F.collect_list("token").over(reach))
    total = F.round(F.col("_s.start") + F.col("end"), 6)
    picked = ends.select("question_id", (-F.col("_s._i")).alias("start_at"), F.col("i").alias("end_at"), total.alias("total"), "_span")
    best = picked.groupBy("question_id").agg(F.min(F.struct((-F.col("total")).alias("t"), "start_at", "end_at", "_span")).alias("m"))
    words = F.slice("m._span", -(F.col("m.end_at") - F.col("m.start_at") + 1).cast("int"), (F.col("m.end_at") - F.col("m.start_at") + 1).cast("int"))
    return best.select("question_id", "m.start_at", "m.end_at", (-F.col("m.t")).alias("total"), F.array_join(words, " ").alias("answer"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def novel_span(questions: DataFrame) -> DataFrame:
    """``questions(question, evidence, ...)`` with ``answer`` and ``confidence``: of the sentence that holds most of the question's words, the
    longest run of words that the question lacks, verbatim; the whole sentence if it has none, and nothing if no word is shared."""
    from docweft.functions import vocabulary as V

    staged = questions.withColumn("_t", T.query_terms(F.coalesce("question", F.lit("")))).withColumn("_all", sentences(F.coalesce("evidence", F.lit(""))))
    staged = staged.withColumn("_best", F.array_max(F.transform("_all", lambda s, i: F.struct(T.overlap(F.col("_t"), s).alias("v"), (-i).alias("k"), s.alias("s")))))
    known = lambda p: p.rlike("^[a-zA-Z0-9]") & (F.lower(p).isin(V.QUERY_STOPWORDS) | F.array_contains("_t", F.lower(p)))
    pieces = F.regexp_extract_all(F.col("_best.s"), F.lit("[a-zA-Z0-9]+|[^a-zA-Z0-9]+"), F.lit(0))
    staged = staged.withColumn("_runs", F.split(F.array_join(F.transform(pieces, lambda p: F.when(known(p), "\u0001").otherwise(p)), ""), "\u0001"))
    size = lambda r: F.size(F.regexp_extract_all(r, F.lit("[a-zA-Z0-9]+"), F.lit(0)))
    staged = staged.withColumn("_run", F.array_max(F.transform("_runs", lambda r, i: F.struct(size(r).alias("n"), (-i).alias("k"), r.alias("r")))))
    run = F.regexp_replace("_run.r", "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "")
    answer = F.when(F.coalesce(F.col("_best.v"), F.lit(0.0)) == 0, "").when(F.col("_run.n") > 0, run).otherwise(F.col("_best.s"))
    return staged.select(*questions.columns, answer.alias("answer"), F.round(F.coalesce("_best.v", F.lit(0.0)), 6).alias("confidence"))
