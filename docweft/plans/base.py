"""Relations that the queries share: the driver's tables seen as documents, chunks, questions, edges and results.

The data has no headings, pages, answers or gold labels of its own, so stated surrogates stand in. Every relation exists
twice, as a DataFrame and as a SQL common table expression; oracles are built from the latter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.session import table

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
FRAMES: dict[str, object] = {}


def relation(name: str, sql: str, needs: tuple[str, ...] = ()):
    """Register the DataFrame function ``fn(spark, sf)`` and its CTE body under ``name``."""
    CTES[name] = (needs, sql)

    def add(fn):
        FRAMES[name] = fn
        return fn

    return add


def with_ctes(names: tuple[str, ...], body: str) -> str:
    """``body`` below the CTEs of ``names`` and of what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " " + body if order else body


@relation(
    "lines",
    """SELECT doc_id * 1000000 + i - 1 AS chunk_id, doc_id AS document_id, source AS owner, lang AS section, i - 1 AS chunk_index, arr[i] AS content
    FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS arr FROM documents), UNNEST(range(1, len(arr) + 1)) AS u(i)""",
)
def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Text chunks: the lines of every document; owner is its source, section its language."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return docs.select(
        (F.col("doc_id") * 1000000 + F.col("i")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("owner"), F.col("lang").alias("section"), F.col("i").cast("long").alias("chunk_index"), "content"
    )


@relation(
    "chunks",
    """SELECT event_id AS chunk_id, user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk_index,
    CASE WHEN event_id % 13 <> 0 THEN day(ts)::BIGINT END AS page, CASE WHEN event_id % 17 <> 0 THEN event_type END AS topic,
    CAST(floor(value) AS BIGINT) AS token_count, props AS content, CASE WHEN user_id % 3 = 0 THEN 'u0' WHEN user_id % 3 = 1 THEN 'u1' ELSE 'u2' END AS owner, ts FROM events""",
)
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without text: events; document is the user, topic the event type, page the day; some pages and topics unknown."""
    e = table(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("chunk_id"),
        F.col("user_id").alias("document_id"),
        (F.row_number().over(order) - 1).cast("long").alias("chunk_index"),
        F.when(F.col("event_id") % 13 != 0, F.dayofmonth("ts").cast("long")).alias("page"),
        F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("topic"),
        F.floor("value").cast("long").alias("token_count"),
        F.col("props").alias("content"),
        F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("owner"),
        "ts",
    )


@relation(
    "questions",
    """SELECT item_id AS question_id, CASE item_id % 8 WHEN 0 THEN 'What is ' WHEN 1 THEN 'Compare ' WHEN 2 THEN 'How many ' WHEN 3 THEN 'List the third of '
    WHEN 4 THEN 'Summarize ' WHEN 5 THEN 'And why ' WHEN 6 THEN 'Find the table below ' ELSE 'Explain how ' END || substr(text, 1, 80) || CASE WHEN item_id % 2 = 0 THEN '?' ELSE '' END AS question,
    text AS evidence FROM benchmark""",
)
def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions: openings of the benchmark items behind varied cue words; the item is the evidence."""
    b = table(spark, sf, "benchmark")
    cue = F.element_at(
        F.array(*map(F.lit, ["What is ", "Compare ", "How many ", "List the third of ", "Summarize ", "And why ", "Find the table below ", "Explain how "])), (F.col("item_id") % 8 + 1).cast("int")
    )
    return b.select(F.col("item_id").alias("question_id"), F.concat(cue, F.substring("text", 1, 80), F.when(F.col("item_id") % 2 == 0, "?").otherwise("")).alias("question"), F.col("text").alias("evidence"))


@relation(
    "paths",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN source WHEN 2 THEN source || ' > ' || lang WHEN 3 THEN source || ' > ' || lang || ' > ' || 'Part ' || (doc_id % 7) ELSE ' ' || source || ' >  > ' || lang END AS heading,
    substr(text, 1, 60) AS content, doc_id % 4 = 0 AS is_heading FROM documents""",
)
def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Heading paths as text, some blank or with empty steps."""
    d, m = table(spark, sf, "documents"), F.col("doc_id") % 5
    s, lang = F.col("source"), F.col("lang")
    heading = (
        F.when(m == 0, "").when(m == 1, s).when(m == 2, F.concat(s, F.lit(" > "), lang)).when(m == 3, F.concat(s, F.lit(" > "), lang, F.lit(" > Part "), (F.col("doc_id") % 7).cast("string"))).otherwise(F.concat(F.lit(" "), s, F.lit(" >  > "), lang))
    )
    return d.select("doc_id", heading.alias("heading"), F.substring("text", 1, 60).alias("content"), (F.col("doc_id") % 4 == 0).alias("is_heading"))


@relation(
    "results",
    """SELECT l_orderkey * 10 + l_linenumber AS rid, l_orderkey AS question_id, l_returnflag AS category, l_linestatus AS arm, l_quantity AS score, l_discount AS confidence,
    l_discount > 0.05 AS correct, l_tax > 0.02 AS answerable, l_partkey AS chunk_id, l_suppkey AS document_id, l_shipdate AS ts FROM lineitem""",
)
def results(spark: SparkSession, sf: str) -> DataFrame:
    """Per-question measurements: order lines; score is the quantity, confidence the discount."""
    c = F.col
    return table(spark, sf, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("rid"), c("l_orderkey").alias("question_id"), c("l_returnflag").alias("category"), c("l_linestatus").alias("arm"), c("l_quantity").alias("score"),
        c("l_discount").alias("confidence"), (c("l_discount") > 0.05).alias("correct"), (c("l_tax") > 0.02).alias("answerable"), c("l_partkey").alias("chunk_id"), c("l_suppkey").alias("document_id"), c("l_shipdate").alias("ts"),
    )


@relation(
    "ranked",
    """SELECT question_id, item, rank, gold FROM (SELECT o_custkey AS question_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank,
    o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS gold FROM orders)""",
)
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """A ranked list per question with gold marks: a customer's orders by price; gold are the urgent ones."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("item"), F.row_number().over(order).cast("long").alias("rank"), (p.like("1%") | p.like("2%")).alias("gold")
    )


@relation(
    "answers",
    """SELECT d.doc_id AS example_id, d.lang AS category, substr(d.text, 1, 40) AS predicted, CASE WHEN d.doc_id % 3 = 0 THEN substr(d.text, 1, 40) WHEN d.doc_id % 3 = 1 THEN substr(d.text, 9, 40) ELSE '' END AS gold,
    d.doc_id % 4 <> 0 AS answerable, d.doc_id % 5 = 0 AS abstained, (d.n_chars % 100) / 100.0::DOUBLE AS confidence, d.source AS source FROM documents d""",
)
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted and gold answers: text openings, equal, shifted or empty."""
    c = F.col
    start = F.substring("text", 1, 40)
    return table(spark, sf, "documents").select(
        c("doc_id").alias("example_id"), c("lang").alias("category"), start.alias("predicted"),
        F.when(c("doc_id") % 3 == 0, start).when(c("doc_id") % 3 == 1, F.substring("text", 9, 40)).otherwise("").alias("gold"),
        (c("doc_id") % 4 != 0).alias("answerable"), (c("doc_id") % 5 == 0).alias("abstained"), ((c("n_chars") % 100) / 100.0).alias("confidence"), "source",
    )


@relation(
    "regions",
    """SELECT p_partkey AS region_id, (p_partkey // 40)::INT AS page, x0, y0, least(x0 + CASE WHEN p_partkey % 23 = 0 THEN 0.8 ELSE 0.05 + (p_partkey % 5) * 0.08 END, 1.2) AS x1, least(y0 + 0.02 + (p_partkey % 3) * 0.03, 1.1) AS y1,
    CASE p_partkey % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'caption' WHEN 2 THEN 'table' ELSE 'text' END AS kind, p_name AS text
    FROM (SELECT *, CASE WHEN p_partkey // 40 % 2 = 0 THEN (p_partkey % 2) * 0.55 + (p_partkey * 37 % 10) / 100.0::DOUBLE ELSE (p_partkey * 37 % 100) / 100.0::DOUBLE END AS x0, (p_partkey * 53 % 97) / 100.0::DOUBLE AS y0 FROM part)""",
)
def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Page regions with boxes: parts, 40 to a page; every other page has two columns, crossed by some wide regions."""
    c = F.col
    key = c("p_partkey")
    x0 = F.when(F.floor(key / 40) % 2 == 0, (key % 2) * 0.55 + (key * 37 % 10) / 100.0).otherwise((key * 37 % 100) / 100.0)
    p = table(spark, sf, "part").withColumn("x0", x0).withColumn("y0", (key * 53 % 97) / 100.0)
    kind = F.element_at(F.array(*map(F.lit, ["figure", "caption", "table", "text"])), (key % 4 + 1).cast("int"))
    width = F.when(key % 23 == 0, 0.8).otherwise(0.05 + (key % 5) * 0.08)
    return p.select(
        key.alias("region_id"), F.floor(key / 40).cast("int").alias("page"), "x0", "y0", F.least(c("x0") + width, F.lit(1.2)).alias("x1"), F.least(c("y0") + 0.02 + (key % 3) * 0.03, F.lit(1.1)).alias("y1"), kind.alias("kind"), c("p_name").alias("text"),
    )


def frame(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return FRAMES[name](spark, sf)
