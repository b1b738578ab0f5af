"""Retrieval variants for evaluation, built from rows of options.

An option row names its stages; each stage is a function from DataFrames to a DataFrame, and all rows share the scored relations,
which are written once. So an ablation is a table of options, not a code path: another row is another variant.

``rank``: ``chunk`` (word overlap) or ``element`` (content and heading). ``keep_zero``: unrelated rows may fill up. ``expand``: ``none``,
``siblings`` (chunks of the same section, interleaved), ``parents`` (elements above those found), ``elements`` (structural stream
behind the semantic one). ``top_k``: evidence of a question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.session import durable

#: Shares of content and heading in an element's score; the four variants compared.
CONTENT, HEADING = 0.7, 0.3
VARIANTS = [
    {"variant": "A", "rank": "chunk", "keep_zero": True, "expand": "none", "top_k": 5},
    {"variant": "B", "rank": "chunk", "keep_zero": False, "expand": "siblings", "top_k": 5},
    {"variant": "C", "rank": "element", "keep_zero": False, "expand": "parents", "top_k": 5},
    {"variant": "D", "rank": "chunk", "keep_zero": False, "expand": "elements", "top_k": 5},
]


def _share(questions: DataFrame, rows: DataFrame, text: str, row_id: str, name: str) -> DataFrame:
    """``question_id, row_id, name``: the share of a question's words that a row of its document holds, by an equi-join on words."""
    asked = questions.select("question_id", "document_id", F.size("terms").alias("_n"), F.explode("terms").alias("word"))
    words = rows.select("document_id", row_id, F.explode(F.array_distinct(T.alnum_tokens(F.col(text)))).alias("word"))
    return asked.join(words, ["document_id", "word"]).groupBy("question_id", row_id, "_n").agg(F.count(F.lit(1)).alias("_k")).select("question_id", row_id, (F.col("_k") / F.col("_n")).alias(name))


def relations(questions: DataFrame, chunks: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    """The scored relations of ``questions(question_id, document_id, question)``, ``chunks(document_id, chunk_id, element_id, content, seq, section)``
    and ``elements(document_id, element_id, parent_id, content, seq, heading)``."""
    asked = questions.select("question_id", "document_id", T.query_terms(F.coalesce("question", F.lit(""))).alias("terms"))
    scope = asked.select("question_id", "document_id").join(chunks.select("document_id", "chunk_id", "seq", "section"), "document_id")
    scored = scope.join(_share(asked, chunks, "content", "chunk_id", "_s"), ["question_id", "chunk_id"], "left").withColumn("score", F.round(F.coalesce("_s", F.lit(0.0)), 6)).drop("_s")
    own, above = _share(asked, elements, "content", "element_id", "_c"), _share(asked, elements, "heading", "element_id", "_h")
    both = own.join(above, ["question_id", "element_id"], "full").select("question_id", "element_id", F.round(CONTENT * F.coalesce("_c", F.lit(0.0)) + HEADING * F.coalesce("_h", F.lit(0.0)), 6).alias("score"))
    return {"chunks": durable(scored), "elements": durable(both.join(elements.select("element_id", "parent_id", "seq"), "element_id")), "parents": elements.select(F.col("element_id").alias("parent_id")).distinct()}


def ranked(scored: DataFrame, row_id: str, keep_zero: bool, top_k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "seq", row_id)
    return scored.where("score > 0" if not keep_zero else "true").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k)


def siblings(base: DataFrame, rel: dict[str, DataFrame], top_k: int) -> DataFrame:
    """Found chunks and, in turns, the other chunks of their sections in source order."""
    more = rel["chunks"].join(base.select("question_id", "document_id", "section").distinct(), ["question_id", "document_id", "section"], "left_semi").join(base.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("question_id").orderBy("seq", "chunk_id")
    return base.select("question_id", F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), (2 * F.col("_r")).alias("_o")).unionByName(
        more.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k).select("question_id", F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), (2 * F.col("_r") + 1).alias("_o"))
    )


def parents(base: DataFrame, rel: dict[str, DataFrame], top_k: int) -> DataFrame:
    """Found elements, then their parents, each once, while there is room."""
    up = base.where("parent_id IS NOT NULL").join(rel["parents"], "parent_id", "left_semi").groupBy("question_id", F.col("parent_id").alias("id")).agg(F.min("_r").alias("_r"))
    up = up.join(base.select("question_id", F.col("element_id").alias("id")), ["question_id", "id"], "left_anti")
    return base.select("question_id", F.col("element_id").alias("id"), F.lit("element").alias("kind"), F.col("_r").alias("_o")).unionByName(up.select("question_id", "id", F.lit("element").alias("kind"), (F.col("_r") + top_k).alias("_o")))


def with_elements(base: DataFrame, rel: dict[str, DataFrame], top_k: int) -> DataFrame:
    """The semantic stream, then the structural one."""
    more = ranked(rel["elements"], "element_id", False, top_k)
    return base.select("question_id", F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), F.col("_r").alias("_o")).unionByName(more.select("question_id", F.col("element_id").alias("id"), F.lit("element").alias("kind"), (F.col("_r") + top_k).alias("_o")))


def alone(base: DataFrame, rel: dict[str, DataFrame], top_k: int) -> DataFrame:
    row_id = "chunk_id" if "chunk_id" in base.columns else "element_id"
    return base.select("question_id", F.col(row_id).alias("id"), F.lit(row_id.removesuffix("_id")).alias("kind"), F.col("_r").alias("_o"))


STAGES = {"none": alone, "siblings": siblings, "parents": parents, "elements": with_elements}


def run(options: list[dict], rel: dict[str, DataFrame]) -> DataFrame:
    """``variant, question_id, place, kind, id``: the evidence of every question under every row of options."""
    out = None
    for row in options:
        base = ranked(rel[f"{row['rank']}s"], f"{row['rank']}_id", row["keep_zero"], row["top_k"])
        found = STAGES[row["expand"]](base, rel, row["top_k"])
        place = F.row_number().over(Window.partitionBy("question_id").orderBy("_o", "id")).cast("long")
        part = found.withColumn("place", place).where(F.col("place") <= row["top_k"]).select(F.lit(row["variant"]).alias("variant"), "question_id", "place", "kind", F.col("id").cast("long").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out
