"""Chunkers, sources and sinks, answers and verification: queries beyond plain SQL, and those SQL reaches only in part."""

from __future__ import annotations

import uuid
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docweft.operators import answers as A
from docweft.operators import chunking as C
from docweft.operators import graph, near, retrieve
from docweft.plans import q_relational  # noqa: F401  registers what the queries below build on
from docweft.plans.base import frame, with_ctes
from docweft.plans.registry import query
from docweft.session import shared_dir, table
from docweft.sources import documents, files

c = F.col


def elements(spark, sf):
    """Elements: the lines of a document; lines with bars are tables, short ones headings, runs of dashes lists."""
    l = frame("lines", spark, sf)
    kind = F.when(c("content").contains("|"), "table").when(F.length("content") < 12, "heading").otherwise("paragraph")
    return l.select("document_id", c("chunk_index").alias("seq"), kind.alias("kind"), "content", F.concat_ws(" > ", "owner", "section").alias("path"), F.floor(c("chunk_index") / 20).alias("page"))


query("chunk_legacy")(lambda s, f: C.legacy(table(s, f, "documents")))
query("chunk_structure")(lambda s, f: C.structured(elements(s, f)))
for _name, _how in (("chunk_prose", ("element", "merge", "split")), ("chunk_list", ("list",)), ("chunk_table", ("table",))):
    if _name != "chunk_list":
        query(_name)(lambda s, f, _how=_how: C.structured(elements(s, f)).where(c("how").isin(*_how)))
query("chunk_list")(lambda s, f: C.structured(elements(s, f).where("kind <> 'heading'").withColumn("kind", F.lit("list"))))
query("truncate_to_tokens")(lambda s, f: table(s, f, "documents").select("doc_id", A.text_udf(lambda t: C.sentence_prefix(t or "", 64), "string")("text").alias("content")))
query("split_claims")(lambda s, f: table(s, f, "documents").select("doc_id", F.posexplode(A.text_udf(A.claims, "array<string>")("text")).alias("place", "claim")))
query("sequence_ratio")(lambda s, f: frame("answers", s, f).select("example_id", A.text_udf(lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 6), "double")("predicted", "gold").alias("ratio")))


def pairs(spark, sf):
    """Every claim (a question) with its evidence text."""
    return frame("questions", spark, sf)


query("prioritize_parts")(lambda s, f: pairs(s, f).select("question_id", A.text_udf(lambda q, e: A.promote_parts([q], A.sentences(e)), "array<int>")("question", "evidence").alias("order")))
query("prepare_prompt")(lambda s, f: pairs(s, f).select("question_id", A.text_udf(lambda q, e: "\n".join(A.fit_prompt(q, [e, e], [q], 400)["evidence"]), "string")("question", "evidence").alias("prompt")))
query("validate_diagram")(lambda s, f: pairs(s, f).select("question_id", A.text_udf(lambda q, e: all(A.valid_diagrams(f"```\n[{e[:20]} [1]]\n```", e)), "boolean")("question", "evidence").alias("valid")))
query("filter_diagrams")(lambda s, f: pairs(s, f).where(A.text_udf(lambda q, e: any(A.valid_diagrams(f"```\n[{e.split(' ')[0]} [1]]\n```", e)), "boolean")("question", "evidence")).select("question_id"))
# A model's answer per relation: no JSON for ids divisible by 5, an unsaid quote for those divisible by 7, the triple twice for the rest.
query("kg_parse_relations", with_ctes(("relations",), "SELECT rid, subject, predicate, object FROM relations WHERE rid % 5 <> 0 AND rid % 7 <> 0"))(lambda s, f: parsed_relations(frame("relations", s, f)))


def parsed_relations(rows):
    said = F.concat_ws(" ", "subject", "predicate", "object")
    triple = F.struct("subject", "predicate", "object", F.when(c("rid") % 7 == 0, "unsaid").otherwise(said).alias("quote"))
    raw = F.when(c("rid") % 5 == 0, "no list").otherwise(F.to_json(F.array(triple, triple)))
    return rows.select("rid", F.inline(graph.parse_relations(raw, F.concat(F.lit("so "), said)))).drop("quote")


query("route_query", with_ctes(("questions",), "SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'graph' WHEN question_id % 3 = 1 THEN 'semantic' ELSE 'both' END AS route FROM questions"))(lambda s, f: pairs(s, f).select("question_id", F.when(c("question_id") % 3 == 0, "graph").when(c("question_id") % 3 == 1, "semantic").otherwise("both").alias("route")))


def bootstrap(spark, sf, rounds=200):
    """Percentile interval of the mean: Poisson resampling by a seeded hash, one aggregation per round inside one job."""
    r = frame("results", spark, sf).groupBy("document_id").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    drawn = r.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", F.pmod(F.xxhash64("document_id", "b"), F.lit(1 << 40)) / float(1 << 40))
    times = F.when(c("u") < 0.3679, 0).when(c("u") < 0.7358, 1).when(c("u") < 0.9197, 2).when(c("u") < 0.9810, 3).otherwise(4)
    means = drawn.groupBy("b").agg((F.sum(c("s") * times) / F.sum(c("n") * times)).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


query("bootstrap_ci")(bootstrap)


# Near duplicates: whole benchmark items.
query("near_dups")(lambda s, f: near.near_pairs(table(s, f, "benchmark").select(c("item_id").alias("id"), c("text").alias("q"))))


def ann(spark, sf, k=10):
    """Approximate top k: inverted lists around centres, of which each question searches the nearest."""
    e = table(spark, sf, "embeddings")
    return retrieve.dense_topk_lists(e.where("vec_id % 20 = 0").select(c("vec_id").alias("question_id"), c("embedding").alias("q")), e.select(c("vec_id").alias("chunk_id"), c("embedding").alias("v")), k)


query("ann_topk")(ann)
query("ann_recall")(lambda s, f: ann(s, f).select("question_id", "chunk_id", F.lit(1).alias("hit")).join(frame("dense", s, f).where("rank <= 10").select("question_id", "chunk_id"), ["question_id", "chunk_id"], "right").groupBy("question_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall")))

# Files
query("read_jsonl", "SELECT doc_id, lang, n_chars FROM documents")(lambda s, f: files.round_trip(table(s, f, "documents").select("doc_id", "lang", "n_chars"), "json", f"{shared_dir(s)}/jsonl-{uuid.uuid4().hex}"))
query("read_csv_reviews", "SELECT doc_id, source, n_chars FROM documents")(lambda s, f: files.round_trip(table(s, f, "documents").select("doc_id", "source", "n_chars"), "csv", f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"))
query("exclusive_write", "SELECT vec_id, label FROM embeddings")(lambda s, f: files.exclusive(table(s, f, "embeddings").select("vec_id", "label"), f"{shared_dir(s)}/once-{uuid.uuid4().hex}"))
query("replace_per_document", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda s, f: files.replace_partitions(table(s, f, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", f"{shared_dir(s)}/parts-{uuid.uuid4().hex}"))
query("validate_file")(lambda s, f: table(s, f, "documents").select("doc_id", A.text_udf(lambda t: A.validate_bytes((t or "").encode(), "txt"), "string")("text").alias("problem")))
query("write_jsonl", "SELECT conv_id, turn, role FROM conversations")(lambda s, f: files.round_trip(table(s, f, "conversations").select("conv_id", "turn", "role"), "json", f"{shared_dir(s)}/jsonl-{uuid.uuid4().hex}"))

LINES_ = "SELECT doc_id AS file_id, trim(UNNEST(string_split(text, chr(10)))) AS content FROM documents WHERE NOT contains(text, chr(1))"


def docx_elements(spark, sf):
    """Documents packed as DOCX (a paragraph for every line) and parsed again."""

    def packed(text):
        return documents.write_docx([("Normal", line) for line in (text or "").split("\n")])

    made = table(spark, sf, "documents").select(c("doc_id").alias("file_id"), F.lit("docx").alias("extension"), A.text_udf(packed, "binary")("text").alias("content"))
    return documents.extract(made)


query("scan_docx", f"SELECT file_id, content FROM ({LINES_}) WHERE content <> ''")(lambda s, f: docx_elements(s, f).select("file_id", "content"))
query("extract_document", f"SELECT file_id, count(*)::BIGINT AS elements FROM ({LINES_}) WHERE content <> '' GROUP BY 1")(lambda s, f: docx_elements(s, f).groupBy("file_id").agg(F.count("*").alias("elements")))
