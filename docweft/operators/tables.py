"""Tables in evidence: parsing, cell and row answers, rows as evidence.

Lines with three or more cells between bars make a table while their number of cells stays the same; its first line is the
header. A *two-key index* answers lookups: the words of a row's first cell must all be in the question (set containment by
counting matches), and of the header cells one must share more words with it than any other. Both matches must be unique, else
the question stays open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V

#: Cells of a table line, words that ask for a whole row, the wording of a lookup, and the limits of rows as evidence.
LEAST_CELLS = 3
ROW_CUES = "values information recorded provided listed details detail data all".split()
LOOKUP = r"(?i)\b(?:what|which|how (?:much|many)|name|list|give)\b"
MOST_TABLES, MOST_ROWS, MOST_TOKENS = 2, 2, 64


def cells_of(line: Column) -> Column:
    """The trimmed cells of a line with bars."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))


def subject_terms(c: Column) -> Column:
    """Distinct words that can name a row or column: stop words stay, question words go."""
    return F.array_distinct(T.without(T.words_of(c, T.CONTENT_TOKEN), V.QUESTION_WORDS))


def parse(blocks: DataFrame) -> DataFrame:
    """``block_id, tbl, row, cells`` of every table with a header (row 0) and a body in ``blocks(block_id, content)``."""
    lines = blocks.select("block_id", F.posexplode(F.split("content", "\r?\n")).alias("_line", "_text"))
    cells = F.when(F.col("_text").contains("|"), cells_of(F.col("_text")))
    wide = lines.withColumn("cells", cells).withColumn("_width", F.when(F.size("cells") >= LEAST_CELLS, F.size("cells")).otherwise(0))
    order = Window.partitionBy("block_id").orderBy("_line")
    begins = (F.col("_width") > 0) & (F.coalesce(F.lag("_width").over(order), F.lit(0)) != F.col("_width"))
    placed = wide.withColumn("_new", begins.cast("long")).withColumn("tbl", F.sum("_new").over(order)).where("_width > 0")
    one = Window.partitionBy("block_id", "tbl")
    rows = placed.withColumn("row", (F.row_number().over(one.orderBy("_line")) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(one))
    return rows.where("_n > 1").select("block_id", "tbl", "row", "cells")


def answer(questions: DataFrame, evidence: DataFrame, tables: DataFrame) -> DataFrame:
    """``question_id, block_id, kind, row_label, column, text``: a cell, or a whole row, of the first table that resolves.

    ``questions(question_id, question)``, ``evidence(question_id, place, block_id)``, ``tables`` as ``parse`` gives them.
    """
    lookups = questions.where(F.col("question").rlike(LOOKUP))
    asked = lookups.select("question_id", F.explode(subject_terms(F.col("question"))).alias("term")).join(evidence, "question_id")
    named = tables.where("row > 0").select("block_id", "tbl", "row", subject_terms(F.get("cells", F.lit(0))).alias("_t"))
    labels = named.select("block_id", "tbl", "row", F.size("_t").alias("_size"), F.explode("_t").alias("term"))
    by_table = ["question_id", "place", "block_id", "tbl"]
    held = asked.join(labels, ["block_id", "term"]).groupBy(*by_table, "row", "_size").agg(F.count(F.lit(1)).alias("_n")).where("_n = _size")
    rows = held.groupBy(*by_table).agg(F.count(F.lit(1)).alias("_rows"), F.min("row").alias("row")).where("_rows = 1").drop("_rows")
    heads = tables.where("row = 0").select("block_id", "tbl", F.posexplode("cells").alias("_col", "column"))
    words = heads.select("block_id", "tbl", "_col", "column", F.explode(subject_terms(F.col("column"))).alias("term"))
    shared = asked.join(words, ["block_id", "term"]).join(rows.select(*by_table), by_table, "left_semi").groupBy(*by_table, "_col", "column").agg(F.count(F.lit(1)).alias("_s"))
    ties = shared.withColumn("_best", F.max("_s").over(Window.partitionBy(*by_table))).where("_s = _best").groupBy(*by_table)
    columns = ties.agg(F.count(F.lit(1)).alias("_cols"), F.min(F.struct("_col", "column")).alias("_c")).where("_cols = 1").select(*by_table, "_c._col", "_c.column")
    met = rows.join(columns, by_table, "left").join(tables, ["block_id", "tbl", "row"]).join(lookups, "question_id")
    wants_row = F.arrays_overlap(T.words_of(F.col("question"), T.CONTENT_TOKEN), F.array(*map(F.lit, ROW_CUES)))
    whole = F.array_join(F.filter("cells", lambda x: x != ""), " | ")
    text = F.when(F.col("_col").isNotNull(), F.get("cells", F.col("_col"))).when(wants_row, whole)
    said = met.select(*by_table, F.when(F.col("_col").isNotNull(), "cell").otherwise("row").alias("kind"), F.get("cells", F.lit(0)).alias("row_label"), "column", text.alias("text")).where("text <> ''")
    first = F.row_number().over(Window.partitionBy("question_id").orderBy("place", "tbl"))
    return said.withColumn("_r", first).where("_r = 1").select("question_id", "block_id", "kind", "row_label", "column", "text")


def row_evidence(questions: DataFrame, rows: DataFrame, most_rows: int = MOST_ROWS, most_tables: int = MOST_TABLES, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """``question_id, table_id, row_index, label_matches, cell_matches, place``: body rows of tables whose header the question names.

    ``questions(question_id, question, document_id)`` pairs questions with the documents whose tables they may use;
    ``rows(document_id, table_id, row_index, is_header, cells, content)``. A header cell opens its table if the question holds its only
    word or two of its words. Rows whose label matches come alone, if there are any; then more matches, then source order. A row
    that exceeds ``most_tokens`` is skipped whole; rows come from at most ``most_tables`` tables.
    """
    asked = questions.select("question_id", "document_id", F.explode(T.question_terms(F.col("question"))).alias("term"))
    heads = rows.where("is_header").select("document_id", "table_id", F.explode("cells").alias("_cell"))
    words = heads.withColumn("_t", T.question_terms(F.col("_cell"))).select("document_id", "table_id", "_cell", F.size("_t").alias("_size"), F.explode("_t").alias("term"))
    hit = asked.join(words, ["document_id", "term"]).groupBy("question_id", "document_id", "table_id", "_cell", "_size").agg(F.count_distinct("term").alias("_n"))
    open_ = hit.where("_size = 1 OR _n >= 2").select("question_id", "document_id", "table_id").distinct()
    body = rows.where("NOT is_header AND trim(content) <> ''").where(T.token_estimate(F.col("content")) <= most_tokens)
    first, every = T.question_terms(F.get("cells", F.lit(0)), 64), T.question_terms(F.array_join("cells", " "), 64)
    terms = body.select("document_id", "table_id", "row_index", F.explode(F.array_union(first, every)).alias("term"), first.alias("_label"), every.alias("_every"))
    marked = terms.select("document_id", "table_id", "row_index", "term", F.array_contains("_label", F.col("term")).alias("_in_label"), F.array_contains("_every", F.col("term")).alias("_in_row"))
    found = asked.join(open_, ["question_id", "document_id"]).join(marked, ["document_id", "table_id", "term"])
    counted = found.groupBy("question_id", "document_id", "table_id", "row_index").agg(F.count_if("_in_label").alias("label_matches"), F.count_if("_in_row").alias("cell_matches"))
    pool = counted.withColumn("_best", F.max("label_matches").over(Window.partitionBy("question_id"))).where("_best = 0 OR label_matches > 0")
    order = [F.desc("label_matches"), F.desc("cell_matches"), "document_id", "table_id", "row_index"]
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).withColumn("_first", F.min("_r").over(Window.partitionBy("question_id", "table_id")))
    kept = ranked.withColumn("_table", F.dense_rank().over(Window.partitionBy("question_id").orderBy("_first"))).where(F.col("_table") <= most_tables)
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("_r")).cast("long")).where(F.col("place") <= most_rows)
    return placed.select("question_id", "table_id", "row_index", "label_matches", "cell_matches", "place")
