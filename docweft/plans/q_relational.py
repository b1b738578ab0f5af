"""Joins, aggregates, windows, paging, set operations, geometry and keyed state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import folds, retrieve
from docweft.plans.base import frame, relation, with_ctes
from docweft.plans.q_scalars import CONTENT
from docweft.plans import q_retrieval  # noqa: F401  registers dense, lexical, edges, tree, islands
from docweft.plans.registry import query
from docweft.session import table

c = F.col
rn = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))

# Joins
query("chunk_document_join", with_ctes(("lines",), "SELECT l.chunk_id, d.n_chars, d.source FROM lines l JOIN documents d ON d.doc_id = l.document_id WHERE d.lang = 'fr'"))(
    lambda s, f: frame("lines", s, f).select("chunk_id", "document_id").join(table(s, f, "documents").where("lang = 'fr'").select(c("doc_id").alias("document_id"), "n_chars", "source"), "document_id").drop("document_id")
)
query("left_join_ready", with_ctes((), "SELECT d.source, count(*)::BIGINT AS n, count(*) FILTER (l.quality = 1) AS ready FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"))(
    lambda s, f: table(s, f, "documents").join(table(s, f, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("quality") == 1).alias("ready"))
)
query("page_pair_join", with_ctes(("chunks",), "SELECT chunk_id FROM chunks WHERE (document_id, page) IN (SELECT document_id, page FROM (SELECT DISTINCT document_id, page FROM chunks WHERE chunk_id % 20 = 0 AND page IS NOT NULL) ORDER BY document_id, page LIMIT 6)"))(
    lambda s, f: frame("chunks", s, f).join(frame("chunks", s, f).where("chunk_id % 20 = 0 AND page IS NOT NULL").select("document_id", "page").distinct().orderBy("document_id", "page").limit(6), ["document_id", "page"], "left_semi").select("chunk_id")
)
query("hydrate_candidates", with_ctes(("dense",), "SELECT question_id, chunk_id, rank, d.source, d.lang FROM dense JOIN documents d ON d.doc_id = chunk_id"))(
    lambda s, f: frame("dense", s, f).join(table(s, f, "documents").select(c("doc_id").alias("chunk_id"), "source", "lang"), "chunk_id").select("question_id", "chunk_id", "rank", "source", "lang")
)
query("hydrate_elements", with_ctes(("tree",), "SELECT t.id, c.c_name AS name FROM tree t JOIN customer c ON t.id = 'c' || c.c_custkey WHERE t.parent_id IN ('n1', 'n2', 'n3')"))(
    lambda s, f: frame("tree", s, f).where("parent_id IN ('n1', 'n2', 'n3')").join(table(s, f, "customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("id"), c("c_name").alias("name")), "id").select("id", "name")
)
query("table_rows_for_docs", with_ctes(("results",), "SELECT document_id, question_id, rid FROM results WHERE document_id IN (SELECT document_id FROM (SELECT document_id, min(rid) AS m FROM results GROUP BY 1 ORDER BY m, document_id LIMIT 5))"))(
    lambda s, f: frame("results", s, f).join(frame("results", s, f).groupBy("document_id").agg(F.min("rid").alias("m")).orderBy("m", "document_id").limit(5), "document_id", "left_semi").select("document_id", "question_id", "rid")
)

# Aggregates
query("insights_structure", with_ctes(("chunks",), "SELECT document_id, count(*)::BIGINT AS chunks, count(DISTINCT page) AS pages, max(page) AS last_page, count(DISTINCT topic) AS sections, round(avg(length(content)), 6) AS mean_length, round(avg(token_count), 6) AS mean_tokens, coalesce(sum(token_count), 0)::BIGINT AS tokens FROM chunks GROUP BY 1"))(
    lambda s, f: frame("chunks", s, f).groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), F.max("page").alias("last_page"), F.count_distinct("topic").alias("sections"), F.round(F.avg(F.length("content")), 6).alias("mean_length"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
)
query("insights_element_types", with_ctes(("chunks",), "SELECT document_id, string_agg(topic || '=' || n, ',' ORDER BY topic) AS types FROM (SELECT document_id, topic, count(*) AS n FROM chunks WHERE topic IS NOT NULL GROUP BY 1, 2) GROUP BY 1"))(
    lambda s, f: frame("chunks", s, f).where("topic IS NOT NULL").groupBy("document_id", "topic").count().groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("topic", F.lit("="), c("count").cast("string")))), ",").alias("types"))
)
query("insights_embedding", with_ctes((), "SELECT d.source, count(e.vec_id) AS embedded, round(count(e.vec_id)::DOUBLE / count(*), 4) AS coverage FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1"))(
    lambda s, f: table(s, f, "documents").select("doc_id", "source").join(table(s, f, "embeddings").select(c("vec_id").alias("doc_id"), F.lit(1).alias("e")), "doc_id", "left").groupBy("source").agg(F.count("e").alias("embedded"), F.round(F.count("e") / F.count("*"), 4).alias("coverage"))
)
query("insights_graph", with_ctes(("edges",), "SELECT document_id, count(*)::BIGINT AS edges, count(*) FILTER (relation = 'NEXT') AS next, count(*) FILTER (relation = 'SAME_PAGE') AS same_page, count(*) FILTER (relation = 'SAME_SECTION') AS same_section FROM edges GROUP BY 1"))(
    lambda s, f: frame("edges", s, f).groupBy("document_id").agg(F.count("*").alias("edges"), F.count_if(c("relation") == "NEXT").alias("next"), F.count_if(c("relation") == "SAME_PAGE").alias("same_page"), F.count_if(c("relation") == "SAME_SECTION").alias("same_section"))
)
METHOD = "CASE WHEN page IS NULL THEN 'none' WHEN token_count < 20 THEN 'ocr' ELSE 'native' END"
method = lambda: F.when(c("page").isNull(), "none").when(c("token_count") < 20, "ocr").otherwise("native")
query("insights_pages", with_ctes(("chunks",), f"SELECT document_id, " + ", ".join(f"count(*) FILTER ({METHOD} = '{k}') AS {k}" for k in ("native", "ocr", "none")) + ", count(*) > 0 AS recorded, (count(DISTINCT page))::BIGINT AS pages FROM chunks GROUP BY 1"))(
    lambda s, f: frame("chunks", s, f).groupBy("document_id").agg(*[F.count_if(method() == k).alias(k) for k in ("native", "ocr", "none")], (F.count("*") > 0).alias("recorded"), F.count_distinct("page").alias("pages"))
)
VERDICT = "CASE WHEN usable = 0 THEN 'error' WHEN usable < n THEN 'partial' ELSE 'ready' END"
query("document_verdict", with_ctes(("chunks",), f"SELECT document_id, {VERDICT} AS verdict FROM (SELECT document_id, count(*) AS n, count(*) FILTER (token_count >= 4) AS usable FROM chunks GROUP BY 1)"))(
    lambda s, f: frame("chunks", s, f).groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(c("token_count") >= 4).alias("usable")).select("document_id", F.expr(VERDICT).alias("verdict"))
)
query("kg_status_rollup", with_ctes(("chunks",), "SELECT owner, CASE WHEN bool_or(topic IN ('view', 'click')) THEN 'available' WHEN bool_or(topic = 'signup') THEN 'pending' WHEN count(*) > 0 THEN 'unavailable' ELSE 'empty' END AS status FROM chunks GROUP BY 1"))(
    lambda s, f: frame("chunks", s, f).groupBy("owner").agg(F.when(F.bool_or(c("topic").isin("view", "click")), "available").when(F.bool_or(c("topic") == "signup"), "pending").otherwise("unavailable").alias("status"))
)
query("document_edge_count", with_ctes(("edges",), "SELECT document_id, count(*)::BIGINT AS n FROM edges GROUP BY 1"))(lambda s, f: frame("edges", s, f).groupBy("document_id").agg(F.count("*").alias("n")))
query("reliability_partition", with_ctes((), "SELECT user_id, count(*)::BIGINT AS n, max((props->>'k')::BIGINT) AS max_hop, count(*) FILTER (event_type = 'view') AS views, bool_or((props->>'k')::INT > 95) AS agreed FROM events GROUP BY 1"))(
    lambda s, f: table(s, f, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("k").alias("max_hop"), F.count_if(c("event_type") == "view").alias("views"), F.bool_or(c("k") > 95).alias("agreed"))
)
query("reliability_summary", with_ctes(("results",), "SELECT question_id, max(score) AS best, round(avg(score), 6) AS mean, count(*)::BIGINT AS sources, count(DISTINCT document_id) AS documents, count(*) FILTER (score >= 25) AS verified FROM results GROUP BY 1"))(
    lambda s, f: frame("results", s, f).groupBy("question_id").agg(F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("sources"), F.count_distinct("document_id").alias("documents"), F.count_if(c("score") >= 25).alias("verified"))
)
query("rag_score_stats", with_ctes(("dense",), "SELECT question_id, round(avg(score), 4) AS mean, round(max(score), 4) AS best, count(DISTINCT chunk_id) AS documents FROM dense GROUP BY 1"))(lambda s, f: frame("dense", s, f).groupBy("question_id").agg(F.round(F.avg("score"), 4).alias("mean"), F.round(F.max("score"), 4).alias("best"), F.count_distinct("chunk_id").alias("documents")))
query("reliability_sources", with_ctes(("results",), "SELECT question_id, rid AS source_id, score AS relevance, category AS path FROM results"))(lambda s, f: frame("results", s, f).select("question_id", c("rid").alias("source_id"), c("score").alias("relevance"), c("category").alias("path")))

# Windows over sequences
query("first_user_preview", with_ctes((), "SELECT conv_id, substr(min_by(text, turn), 1, 120) AS preview FROM conversations WHERE role = 'user' GROUP BY 1"))(lambda s, f: table(s, f, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 120).alias("preview")))
query("history_tail", with_ctes((), "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 3"))(lambda s, f: table(s, f, "conversations").where("role IN ('user', 'assistant')").withColumn("r", rn(["conv_id"], F.desc("turn"))).where("r <= 3").select("conv_id", "turn", "role"))
query("last_user_question", with_ctes((), "SELECT conv_id, trim(max_by(text, turn)) AS question FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1"))(lambda s, f: table(s, f, "conversations").where("role = 'user' AND trim(text) <> ''").groupBy("conv_id").agg(F.trim(F.max_by("text", "turn")).alias("question")))
LEVEL = "(1 + chunk_index * 7 % 3)"
HEADS = f"SELECT document_id, chunk_id, chunk_index, {LEVEL}::INT AS level, coalesce(topic, 'none') AS heading FROM chunks"


@relation("headings", HEADS, ("chunks",))
def headings(spark, sf):
    """Headings with levels 1 to 3 in sequence, made of the chunks."""
    return frame("chunks", spark, sf).select("document_id", "chunk_id", "chunk_index", (1 + c("chunk_index") * 7 % 3).cast("int").alias("level"), F.coalesce("topic", F.lit("none")).alias("heading"))


def heading_paths(spark, sf):
    """Path of every heading: the fold ``path[:level-1] + [heading]`` along each document."""
    return folds.along_documents(frame("headings", spark, sf), folds.HeadingStack(), "document_id", "chunk_index", "chunk_id").select("chunk_id", "path")


query("heading_path_scan", with_ctes(("headings",), "SELECT chunk_id, array_to_string(path, ' > ') AS path FROM (WITH RECURSIVE r AS (SELECT document_id, chunk_id, chunk_index, [heading] AS path FROM headings WHERE chunk_index = 0 UNION ALL SELECT h.document_id, h.chunk_id, h.chunk_index, list_append(r.path[1:h.level - 1], h.heading) FROM r JOIN headings h ON h.document_id = r.document_id AND h.chunk_index = r.chunk_index + 1) SELECT * FROM r)"))(heading_paths)
query("parent_from_path", with_ctes(("headings",), "SELECT chunk_id, max(CASE WHEN level = 1 THEN chunk_index END) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_index FROM headings"))(
    lambda s, f: frame("headings", s, f).select("chunk_id", F.max(F.when(c("level") == 1, c("chunk_index"))).over(Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)).alias("parent_index"))
)
query("table_row_records", with_ctes(("lines",), "SELECT chunk_id, h.header || ' | ' || content AS record FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM lines WHERE contains(content, '|')) b JOIN (SELECT document_id, first(content ORDER BY chunk_index) AS header FROM lines WHERE contains(content, '|') GROUP BY 1) h USING (document_id) WHERE r > 1 AND trim(content) <> ''"))(lambda s, f: _table_rows(frame("lines", s, f)))


def _table_rows(l):
    """Body rows of a document's table lines with its header repeated."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    t = l.where(c("content").contains("|")).withColumn("r", F.row_number().over(w)).withColumn("header", F.first("content").over(w))
    return t.where("r > 1 AND trim(content) <> ''").select("chunk_id", F.concat("header", F.lit(" | "), "content").alias("record"))


# Paging, sets
query("paged_chunks", with_ctes(("chunks",), "SELECT chunk_id, chunk_index FROM chunks WHERE document_id = 8 ORDER BY chunk_index, chunk_id LIMIT 25 OFFSET 10"))(lambda s, f: frame("chunks", s, f).where("document_id = 8").orderBy("chunk_index", "chunk_id").offset(10).limit(25).select("chunk_id", "chunk_index"))
query("list_newest", with_ctes((), "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50"))(lambda s, f: table(s, f, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50))
query("revisions_page", with_ctes((), "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20"))(lambda s, f: table(s, f, "orders").where("o_custkey % 10 = 1").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(20).limit(20).select("o_orderkey"))
query("union_distinct_nodes", with_ctes(("edges",), "SELECT document_id, count(*)::BIGINT AS nodes FROM (SELECT document_id, source AS n FROM edges UNION SELECT document_id, target FROM edges) GROUP BY 1"))(
    lambda s, f: frame("edges", s, f).select("document_id", F.explode(F.array("source", "target")).alias("n")).distinct().groupBy("document_id").agg(F.count("*").alias("nodes"))
)

# Geometry
SPAN = "SELECT document_id, (chunk_index * 13 % 97)::BIGINT AS s, (chunk_index * 13 % 97 + 1 + token_count % 6)::BIGINT AS e FROM chunks"
spans = lambda s, f: frame("chunks", s, f).select("document_id", (c("chunk_index") * 13 % 97).alias("s"), (c("chunk_index") * 13 % 97 + 1 + c("token_count") % 6).alias("e"))
query("merge_intervals", with_ctes(("chunks",), f"SELECT document_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY document_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ({SPAN}))) GROUP BY document_id, g"))(lambda s, f: _merged(spans(s, f)))


def _merged(x):
    w = Window.partitionBy("document_id").orderBy("s", "e")
    new = F.when(c("s") <= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    g = x.withColumn("n", new).withColumn("g", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("document_id", "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("g")


OVER = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"
query("bbox_overlap", with_ctes(("regions",), f"SELECT a.region_id, b.region_id AS inside FROM regions a JOIN regions b ON a.page = b.page AND a.region_id <> b.region_id WHERE round({OVER} / {AREA}, 9) > 0.5"))(
    lambda s, f: frame("regions", s, f).alias("a").join(frame("regions", s, f).alias("b"), F.expr("a.page = b.page AND a.region_id <> b.region_id")).where(F.expr(f"round(({OVER}) / {AREA}, 9) > 0.5")).select("a.region_id", c("b.region_id").alias("inside"))
)
query("validate_visual_patches", with_ctes((), "SELECT vec_id, len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AS valid FROM embeddings"))(
    lambda s, f: table(s, f, "embeddings").select("vec_id", ((F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: ~F.isnan(x))).alias("valid"))
)
query("visual_topk", with_ctes((), "SELECT vec_id AS chunk_id, score FROM (SELECT v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE v.label = 3) ORDER BY score DESC, chunk_id LIMIT 8"))(
    lambda s, f: retrieve.dense_topk(table(s, f, "embeddings").where("vec_id = 7").select(F.lit(0).alias("question_id"), c("embedding").alias("q")), table(s, f, "embeddings").where("label = 3").select(c("vec_id").alias("chunk_id"), c("embedding").alias("v")), 8).select("chunk_id", "score")
)

# Spans and answers
LOGITS = "SELECT question_id, rid % 10 AS i, score AS s, round(score * 0.7 + (rid % 7), 6) AS e FROM results WHERE question_id % 20 = 0"
JOINT = f"SELECT a.question_id, a.i AS start_at, b.i AS end_at, round(a.s + b.e, 6) AS total FROM ({LOGITS}) a JOIN ({LOGITS}) b ON a.question_id = b.question_id AND b.i BETWEEN a.i AND a.i + 3"
logits = lambda s, f: frame("results", s, f).where("question_id % 20 = 0").select("question_id", (c("rid") % 10).alias("i"), c("score").alias("s"), F.round(c("score") * 0.7 + c("rid") % 7, 6).alias("e"))
joint = lambda s, f: logits(s, f).alias("a").join(logits(s, f).alias("b"), F.expr("a.question_id = b.question_id AND b.i BETWEEN a.i AND a.i + 3")).select("a.question_id", c("a.i").alias("start_at"), c("b.i").alias("end_at"), F.round(c("a.s") + c("b.e"), 6).alias("total"))
query("span_tiebreak", with_ctes(("results",), f"SELECT question_id, start_at, end_at FROM (SELECT DISTINCT question_id, start_at, end_at, total FROM ({JOINT})) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY total DESC, end_at - start_at, start_at) = 1"))(
    lambda s, f: joint(s, f).groupBy("question_id").agg(F.min(F.struct(-c("total"), c("end_at") - c("start_at"), c("start_at"), c("end_at"))).alias("m")).select("question_id", c("m.start_at").alias("start_at"), c("m.end_at").alias("end_at"))
)
TAX = "CASE WHEN predicted = '' OR gold = '' THEN 'EMPTY' WHEN predicted = gold THEN 'EXACT' WHEN contains(gold, predicted) THEN 'TOO_SHORT' WHEN contains(predicted, gold) THEN 'TOO_LONG' WHEN contains(predicted, substr(gold, 1, 8)) THEN 'OVERLAP' ELSE 'DISJOINT' END"
query("span_taxonomy", with_ctes(("answers",), f"SELECT example_id, {TAX} AS kind FROM answers"))(lambda s, f: frame("answers", s, f).select("example_id", F.expr(TAX).alias("kind")))
WORDS = "SELECT question_id, UNNEST(list_distinct(w)) AS t FROM (SELECT question_id, " + CONTENT("question") + " AS w FROM questions)"
query("rare_question_term", with_ctes(("questions",), f"SELECT question_id, min_by(t, k) AS term FROM (SELECT question_id, t, df * 1000000 + row_number() OVER (ORDER BY t) AS k FROM (SELECT question_id, t, count(*) OVER (PARTITION BY t) AS df FROM ({WORDS}))) GROUP BY 1"))(
    lambda s, f: frame("questions", s, f).select("question_id", F.explode(F.array_distinct(T.content_tokens(c("question")))).alias("t")).withColumn("df", F.count("*").over(Window.partitionBy("t"))).groupBy("question_id").agg(F.min(F.struct("df", "t")).alias("m")).select("question_id", c("m.t").alias("term"))
)
# Keyed state, batch forms
query("conversation_append", with_ctes((), "SELECT conv_id, turn, role, substr(text, 1, 8000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL) WHERE r <= 12"))(
    lambda s, f: table(s, f, "conversations").where("role IN ('user', 'assistant') AND text IS NOT NULL").withColumn("r", rn(["conv_id"], F.desc("turn"))).where("r <= 12").select("conv_id", "turn", "role", F.substring("text", 1, 8000).alias("content"))
)
query("latest_per_user_upsert", with_ctes((), "SELECT user_id, max(ts) AS ts, max_by(event_id, ts) AS event_id, max_by(event_type, ts) AS event_type FROM events GROUP BY 1"))(lambda s, f: table(s, f, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", "ts").alias("event_id"), F.max_by("event_type", "ts").alias("event_type")))
query("entity_insert_ignore", with_ctes((), "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2"))(lambda s, f: table(s, f, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")))
query("dedupe_upload", with_ctes((), "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS existing FROM documents"))(lambda s, f: table(s, f, "documents").select("doc_id", F.min("doc_id").over(Window.partitionBy("source", F.sha2("text", 256))).alias("existing")))
query("stale_processing", with_ctes((), "SELECT event_id FROM events WHERE event_type = 'error' AND date_sub('second', ts, (SELECT max(ts) FROM events)) > 600"))(
    lambda s, f: table(s, f, "events").where("event_type = 'error'").join(F.broadcast(table(s, f, "events").agg(F.max("ts").alias("now")))).where(F.timestamp_diff("SECOND", "ts", "now") > 600).select("event_id")
)
query("revision_sources", with_ctes(("lines",), "SELECT document_id, chunk_id, chunk_index, section FROM lines"))(lambda s, f: _revision(frame("lines", s, f)))


def _revision(l):
    """Chunks as one JSON snapshot per document and read back from it."""
    shots = l.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "section")))).alias("payload"))
    return shots.select("document_id", F.explode(F.from_json("payload", "array<struct<chunk_index:bigint,chunk_id:bigint,section:string>>")).alias("x")).select("document_id", "x.chunk_id", "x.chunk_index", "x.section")


query("db_scan", with_ctes((), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"))(lambda s, f: table(s, f, "nation").join(table(s, f, "region"), c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name"))
query("scan_txt", with_ctes((), "SELECT doc_id, i AS seq, p[i] AS content FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.]) ', '\\1' || chr(10) || chr(10), 'g'), '\\n\\s*\\n') AS p FROM documents), UNNEST(range(1, len(p) + 1)) AS u(i) WHERE trim(p[i]) <> ''"))(
    lambda s, f: table(s, f, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "([.]) ", "$1\n\n"), r"\n\s*\n")).alias("i", "content")).where("trim(content) <> ''").select("doc_id", (c("i") + 1).cast("long").alias("seq"), "content")
)
