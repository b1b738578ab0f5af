"""Retrieval systems under common controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import controls, graph
from docweft.plans import q_retrieval as R
from docweft.plans.base import frame
from docweft.plans.q_evidence import walked
from docweft.plans.registry import query
from docweft.session import durable, table

c = F.col


def asked(spark, sf):
    """A document whose id is divisible by 20 asks with its first line; routes and marks take turns, three graphs in four are ready."""
    turn, line = F.floor(c("doc_id") / 20), F.get(F.split("text", "\n"), F.lit(0))
    marks = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(15)), (turn % 3 + 1).cast("int"))
    route, state = F.when(turn % 3 == 0, "graph").when(turn % 3 == 1, "semantic").otherwise("both"), F.when(turn % 4 != 0, "available")
    return table(spark, sf, "documents").where("doc_id % 20 = 0").select(c("doc_id").alias("question_id"), line.alias("question"), marks.alias("marks"), route.alias("route"), state.alias("graph_state"))


def contents(spark, sf):
    """Chunks with their place and size, and texts by id: the document of that id, else what the event holds."""
    docs = table(spark, sf, "documents").select(c("doc_id").alias("chunk_id"), c("source").alias("document"), F.lit(None).cast("long").alias("page"), c("text").alias("content"))
    events = frame("chunks", spark, sf)
    sizes = docs.select("chunk_id", F.octet_length("content").alias("_bytes"))
    bytes_ = F.coalesce("_bytes", F.octet_length("content"), F.lit(0)).cast("long")
    chunks = events.join(sizes, "chunk_id", "left").select("chunk_id", "document_id", "chunk_index", "topic", bytes_.alias("bytes"), F.ceil(bytes_ / 4).alias("tokens"))
    others = events.join(docs.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", c("document_id").cast("string").alias("document"), "page", "content")
    return chunks, docs.unionByName(others)


def reranker(questions, texts):
    """A stand-in for the model: the share of the question's words that a candidate's text holds."""
    said = questions.select("question_id", F.array_distinct(T.alnum_tokens(F.coalesce("question", F.lit("")))).alias("_q"))

    def rerank(pairs):
        words = texts.select("chunk_id", F.array_distinct(T.alnum_tokens(F.coalesce("content", F.lit("")))).alias("_w"))
        shared = F.size(F.array_intersect("_q", F.coalesce("_w", F.array().cast("array<string>"))))
        met = pairs.join(said, "question_id").join(words.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", "left")
        return met.select("question_id", "chunk_id", F.round(F.when(F.size("_q") > 0, shared / F.size("_q")).otherwise(0.0), 6).alias("score"))

    return rerank


def structured_query_controls(spark, sf, held=controls.Controls()):
    questions, (chunks, texts) = durable(asked(spark, sf)), contents(spark, sf)
    near = durable(R.dense(spark, sf, held.candidate_depth).select("question_id", "chunk_id", "rank"))
    found = durable(R.lexical(spark, sf, held.candidate_depth).select("question_id", "chunk_id", "rank"))
    linked = graph.walk_relations(*R.linked(spark, sf), hops=held.graph_hops, most=held.candidate_depth).select("question_id", "chunk_id", c("place").alias("rank"))
    return controls.compare(questions, near, found, walked(near, frame("edges", spark, sf)), linked, chunks, texts, reranker(questions, texts), held)


query("structured_query_controls")(structured_query_controls)
