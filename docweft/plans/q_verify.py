"""Queries over tables in evidence, numeric alignment and claim relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.operators import alignment, relations, tables
from docweft.operators import claims as K
from docweft.plans.base import frame, relation, with_ctes
from docweft.plans.q_scalars import sql_list, sql_tokens, sql_without
from docweft.plans.registry import query
from docweft.session import durable, table

c = F.col
CELLS = 40
TOKEN = "[a-z0-9][a-z0-9.%/-]*"


# Sheets: blocks of text with a table of 40 customers each, broken by a note after some rows. A customer asks about itself or the next.
@relation(
    "sheets",
    f"""SELECT c_custkey // {CELLS} AS block_id, 'Customers.' || chr(10) || 'Entry | Segment | Nation Code | Balance' || chr(10) || string_agg('| ' || c_name || ' | ' || lower(c_mktsegment) || ' | ' || c_nationkey || ' | ' || round(c_acctbal * 100)::BIGINT ||
    CASE WHEN c_custkey % 13 = 0 THEN chr(10) || 'See the note.' ELSE '' END, chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY 1""",
)
def sheets(spark, sf):
    row = F.concat(F.lit("| "), "c_name", F.lit(" | "), F.lower("c_mktsegment"), F.lit(" | "), c("c_nationkey").cast("string"), F.lit(" | "), F.round(c("c_acctbal") * 100).cast("long").cast("string"), F.when(c("c_custkey") % 13 == 0, "\nSee the note.").otherwise(""))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda x: x["row"])
    grouped = table(spark, sf, "customer").groupBy(F.floor(c("c_custkey") / CELLS).alias("block_id"))
    return grouped.agg(F.concat(F.lit("Customers.\nEntry | Segment | Nation Code | Balance\n"), F.array_join(rows, "\n")).alias("content"))


@relation(
    "lookups",
    f"""SELECT c_custkey AS question_id, c_custkey // {CELLS} AS own, CASE c_custkey % 6 WHEN 0 THEN 'What is the segment of ' || c_name || '?' WHEN 1 THEN 'How much is the balance for ' || c_name || '?' WHEN 2 THEN 'What are all the values for ' || c_name || '?'
    WHEN 3 THEN 'Where is the segment of ' || c_name || ' described?' WHEN 4 THEN 'What is the balance and segment of ' || c_name || '?' ELSE 'Which nation code does Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') || ' have?' END AS question FROM customer""",
)
def lookups(spark, sf):
    name, form = c("c_name"), c("c_custkey") % 6
    said = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    following = F.concat(F.lit("Which nation code does Customer#"), F.lpad((c("c_custkey") + 1).cast("string"), 9, "0"), F.lit(" have?"))
    question = F.when(form == 0, said("What is the segment of ", "?")).when(form == 1, said("How much is the balance for ", "?")).when(form == 2, said("What are all the values for ", "?")).when(form == 3, said("Where is the segment of ", " described?"))
    return table(spark, sf, "customer").select(c("c_custkey").alias("question_id"), F.floor(c("c_custkey") / CELLS).alias("own"), question.when(form == 4, said("What is the balance and segment of ", "?")).otherwise(following).alias("question"))


SUBJECT = lambda text: f"list_distinct({sql_without(sql_tokens(text, TOKEN), V.QUESTION_WORDS)})"
relation(
    "sheet_rows",
    """SELECT block_id, tbl, row, cells FROM (SELECT *, row_number() OVER (PARTITION BY block_id, tbl ORDER BY line) - 1 AS row, count(*) OVER (PARTITION BY block_id, tbl) AS n FROM (
    SELECT *, sum(CASE WHEN width > 0 AND width IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY line) AS tbl FROM (SELECT *, lag(width) OVER (PARTITION BY block_id ORDER BY line) AS before FROM (
    SELECT block_id, i AS line, cells, CASE WHEN contains(text, '|') AND len(cells) >= 3 THEN len(cells) ELSE 0 END AS width FROM (SELECT block_id, i, ls[i] AS text, list_transform(string_split(trim(trim(ls[i]), '|'), '|'), lambda x: trim(x)) AS cells
    FROM (SELECT block_id, string_split(content, chr(10)) AS ls FROM sheets), UNNEST(range(1, len(ls) + 1)) AS t(i))))) WHERE width > 0) WHERE n > 1""",
    ("sheets",),
)
ASKED = f"SELECT question_id, question, {SUBJECT('question')} AS q, own, UNNEST([1, 2]) AS place FROM lookups WHERE regexp_matches(question, '(?i)\\b(what|which|how (much|many)|name|list|give)\\b')"
query(
    "table_answer",
    with_ctes(
        ("sheet_rows", "lookups"),
        f"""SELECT question_id, block_id, kind, row_label, "column", text FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place, tbl) AS r FROM (
        SELECT question_id, place, b.block_id, b.tbl, CASE WHEN k.col IS NULL THEN 'row' ELSE 'cell' END AS kind, b.cells[1] AS row_label, k.name AS "column",
          CASE WHEN k.col IS NOT NULL THEN b.cells[k.col] WHEN len(list_intersect({sql_tokens('question', TOKEN)}, {sql_list(tables.ROW_CUES)})) > 0 THEN array_to_string(list_filter(b.cells, lambda x: x <> ''), ' | ') END AS text
        FROM (SELECT question_id, question, q, place, block_id, tbl, min(row) AS row FROM ({ASKED}) a JOIN (SELECT *, {SUBJECT('cells[1]')} AS label FROM sheet_rows WHERE row > 0) s ON s.block_id = CASE a.place WHEN 1 THEN own + 1 ELSE own END
          WHERE len(label) > 0 AND len(list_filter(label, lambda t: NOT list_contains(q, t))) = 0 GROUP BY ALL HAVING count(*) = 1) m JOIN sheet_rows b USING (block_id, tbl, row)
        LEFT JOIN (SELECT question_id, place, block_id, tbl, min(col) AS col, min_by(name, col) AS name FROM (SELECT *, max(s) OVER (PARTITION BY question_id, place, block_id, tbl) AS best FROM (
          SELECT question_id, place, block_id, tbl, i AS col, cells[i] AS name, len(list_intersect(q, {SUBJECT('cells[i]')})) AS s FROM ({ASKED}) a JOIN sheet_rows h ON h.row = 0 AND h.block_id = CASE a.place WHEN 1 THEN own + 1 ELSE own END, UNNEST(range(1, len(cells) + 1)) AS t(i)) WHERE s > 0) WHERE s = best GROUP BY ALL HAVING count(*) = 1) k
          USING (question_id, place, block_id, tbl)) WHERE text <> '') WHERE r = 1""",
    ),
)(lambda s, f: tables.answer(frame("lookups", s, f).select("question_id", "question"), _evidence(frame("lookups", s, f)), durable(tables.parse(frame("sheets", s, f)))))


def _evidence(asked):
    """Two blocks of each question: the one after its own, then its own."""
    return asked.select("question_id", F.posexplode(F.array(c("own") + 1, c("own"))).alias("place", "block_id")).withColumn("place", c("place") + 1)


# Rows as evidence: the tables of a question's own sheet; the header repeats before each row's content.
TERMS = lambda text, most: f"list_distinct(list_filter({sql_tokens(text)}, lambda t: length(t) >= 3 AND NOT list_contains({sql_list(V.TERM_STOPWORDS)}, t)))"
relation("sheet_terms", f"SELECT block_id, tbl, row, cells, {TERMS('cells[1]', 64)} AS label, {TERMS('array_to_string(cells, chr(32))', 64)} AS every FROM sheet_rows", ("sheet_rows",))
query(
    "table_row_evidence",
    with_ctes(
        ("sheet_terms", "lookups"),
        f"""SELECT question_id, table_id, row_index, label_matches, cell_matches, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r) AS place FROM (SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY first) AS nth FROM (
        SELECT *, min(r) OVER (PARTITION BY question_id, table_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY label_matches DESC, cell_matches DESC, block_id, table_id, row_index) AS r FROM (
        SELECT *, max(label_matches) OVER (PARTITION BY question_id) AS best FROM (SELECT question_id, s.block_id, s.block_id || ':' || s.tbl AS table_id, s.row AS row_index, len(list_intersect(s.label, q)) AS label_matches, len(list_intersect(s.every, q)) AS cell_matches
        FROM (SELECT question_id, own, {TERMS('question', 8)}[1:8] AS q FROM lookups) a JOIN sheet_terms s ON s.block_id = a.own AND s.row > 0 WHERE greatest(1, ceil(length(array_to_string(s.cells, ' | ')) / 4)) <= 64 AND EXISTS (SELECT 1 FROM sheet_terms h, UNNEST(h.cells) AS u(cell)
          WHERE h.block_id = s.block_id AND h.tbl = s.tbl AND h.row = 0 AND len(list_intersect({TERMS('cell', 8)}, q)) >= CASE WHEN len({TERMS('cell', 8)}) = 1 THEN 1 ELSE 2 END)) WHERE cell_matches > 0) WHERE best = 0 OR label_matches > 0))) WHERE nth <= 2) WHERE place <= 2""",
    ),
)(lambda s, f: tables.row_evidence(frame("lookups", s, f).select("question_id", "question", c("own").alias("document_id")), _records(durable(tables.parse(frame("sheets", s, f))))))


def _records(rows):
    return rows.select(c("block_id").alias("document_id"), F.concat_ws(":", "block_id", "tbl").alias("table_id"), c("row").alias("row_index"), (c("row") == 0).alias("is_header"), "cells", F.array_join("cells", " | ").alias("content"))


# Which resolver a document's evidence admits: a table, a list (a heading and two items), or none.
query(
    "structured_answer_gate",
    with_ctes(("sheet_rows", "lookups"), "SELECT l.question_id, CASE WHEN EXISTS (SELECT 1 FROM sheet_rows r WHERE r.block_id = l.own) AND regexp_matches(question, '(?i)\\b(what|which|how (much|many)|name|list|give)\\b') THEN 'table' ELSE 'generate' END AS resolver FROM lookups l"),
)(lambda s, f: frame("lookups", s, f).join(tables.parse(frame("sheets", s, f)).select(c("block_id").alias("own"), F.lit(True).alias("_t")).distinct(), "own", "left").select("question_id", F.when(c("_t") & c("question").rlike(tables.LOOKUP), "table").otherwise("generate").alias("resolver")))


# Alignment: a document asks with its first line about its own text; the claim is the first line with a digit of the next document.
def entity_alignment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    valued = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9]")), F.lit(0))
    claims = docs.select((c("doc_id") - 1).alias("doc_id"), valued.alias("claim")).where("claim IS NOT NULL")
    asked = docs.select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("question"), c("text").alias("evidence"))
    return alignment.align(asked.join(claims, "doc_id")).select("doc_id", "alignment")


query("entity_alignment")(entity_alignment)


# Relations: the sentences of a benchmark item are claims; its evidence is every line that holds most of the item's words.
def relation_verdict(spark, sf):
    items = table(spark, sf, "benchmark").select(c("item_id").alias("answer_id"), F.posexplode(T.sentences(c("text"))).alias("k", "claim"))
    claims = items.select(F.concat_ws(":", "answer_id", "k").alias("claim_id"), "answer_id", "claim", F.lit(None).cast("string").alias("question"), F.array().cast("array<bigint>").alias("stated"))
    found = frame("attributed", spark, sf).select(c("claim_id").alias("answer_id"), c("block_id").alias("block"))
    return relations.verify_claims(claims, K.evidence(found, frame("lines", spark, sf).select(c("chunk_id").alias("block"), "content"), "answer_id"))


query("relation_verdict")(relation_verdict)
