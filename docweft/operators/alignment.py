"""Whether a numeric claim's value belongs to the entity that the question asks about.

Three readings of the evidence are tried in order; the first that applies decides. In a *table* the header names the asked column and
the first cell the row. In a *list* an item belongs to the heading that holds the question's rarest term. In *prose* a sentence with the
value must share the subject of the first sentence that holds that term, or hold the term itself.

All steps are column expressions, staged so that each array is computed once per row: ``matched``, ``mismatch``, ``unable`` (the value
is nowhere) or ``not_applicable`` (no number in the claim, or too little structure).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.operators.tables import LEAST_CELLS, cells_of

#: Words of a subject, and lines of a list at least.
SUBJECT_WORDS, LIST_LINES = 2, 3


def raw_terms(c: Column) -> Column:
    """Distinct words of three letters or more that are no question words."""
    return F.array_distinct(F.filter(T.words_of(c, T.CONTENT_TOKEN), lambda t: (F.length(t) > 2) & ~t.isin(V.QUESTION_WORDS)))


def subject(sentence: Column) -> Column:
    """The first content words before the first number, or of the whole sentence."""
    head = F.slice(T.content_tokens(F.get(F.split(sentence, r"\d", 2), F.lit(0))), 1, SUBJECT_WORDS)
    return F.when(F.size(head) > 0, head).otherwise(F.slice(T.content_tokens(sentence), 1, SUBJECT_WORDS))


def align(rows: DataFrame) -> DataFrame:
    """``rows(question, claim, evidence, ...)`` with ``alignment``."""
    holds = lambda text: F.arrays_overlap(T.numbers(text), F.col("_n"))
    out = rows.withColumn("_n", T.numbers(T.strip_citations(F.coalesce("claim", F.lit(""))))).withColumn("_s", T.sentences(F.col("evidence"))).withColumn("_q", raw_terms(F.coalesce("question", F.lit(""))))
    # Tables
    tabular = F.filter(F.transform(F.filter("_s", lambda s: s.contains("|")), cells_of), lambda r: F.size(r) >= LEAST_CELLS)
    out = out.withColumn("_t", tabular).withColumn("_header", F.get("_t", F.lit(0))).withColumn("_rows", F.filter(F.slice("_t", 2, 1 << 20), lambda r: F.size(r) == F.size("_header")))
    shared = F.transform(F.slice("_header", 2, 1 << 20), lambda x: F.size(F.array_intersect(raw_terms(x), F.col("_q"))))
    out = out.withColumn("_shared", F.when(F.size("_rows") > 0, shared)).withColumn("_most", F.array_max("_shared"))
    out = out.withColumn("_asked", F.when(F.col("_most") > 0, F.array_position("_shared", F.col("_most")).cast("int")))
    out = out.withColumn("_valued", F.filter("_rows", lambda r: F.exists(r, holds)))
    out = out.withColumn("_named", F.get(F.filter("_valued", lambda r: F.arrays_overlap(raw_terms(F.get(r, F.lit(0))), F.col("_q"))), F.lit(0)))
    elsewhere = F.exists(F.transform("_named", lambda x, i: holds(x) & (i != F.col("_asked"))), lambda x: x)
    by_table = F.when(F.col("_asked").isNotNull(), F.when(F.size("_valued") == 0, "unable").when(F.col("_named").isNotNull() & ~elsewhere, "matched").otherwise("mismatch"))
    # The question's rarest term among sentences
    out = out.withColumn("by_table", by_table).withColumn("_words", F.transform("_s", T.content_tokens))
    counted = F.transform(F.array_distinct(T.without(T.content_tokens(F.coalesce("question", F.lit(""))), V.QUESTION_WORDS)), lambda t: F.struct(F.size(F.filter("_words", lambda w: F.array_contains(w, t))).alias("n"), t.alias("t")))
    out = out.withColumn("_focus", F.array_min(F.filter(counted, lambda x: x["n"] > 0))["t"]).withColumn("_stem", T.stem(F.col("_focus")))
    # Lists
    runs = F.transform(F.split("evidence", r"\n[ \t\r]*\n"), lambda r: F.filter(F.transform(F.split(r, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    claim = T.normalize(T.strip_citations(F.coalesce("claim", F.lit(""))))
    in_list = F.exists(runs, lambda r: (F.size(r) >= LIST_LINES) & F.array_contains(T.stems(raw_terms(F.get(r, F.lit(0)))), F.col("_stem")) & F.exists(F.slice(r, 2, 1 << 20), lambda x: T.normalize(x).contains(claim)))
    out = out.withColumn("_in_list", F.col("_focus").isNotNull() & (claim != "") & in_list)
    # Prose
    out = out.withColumn("_anchor", subject(F.get(F.filter("_s", lambda s: F.array_contains(T.content_tokens(s), F.col("_focus"))), F.lit(0)))).withColumn("_value_words", F.transform(F.filter("_s", holds), T.content_tokens))
    near = F.exists("_value_words", lambda w: (F.size(F.array_except("_anchor", w)) == 0) | F.array_contains(T.stems(w), F.col("_stem")))
    prose = F.when(F.col("_focus").isNull(), "not_applicable").when(F.size("_anchor") == 0, "not_applicable").when(F.size("_value_words") == 0, "unable").when(near, "matched").otherwise("mismatch")
    decided = F.when((F.size("_n") == 0) | (F.size("_s") < 2), "not_applicable").when(F.col("by_table").isNotNull(), F.col("by_table")).when(F.coalesce("_in_list", F.lit(False)), "matched").otherwise(prose)
    return out.select(*rows.columns, decided.alias("alignment"))
