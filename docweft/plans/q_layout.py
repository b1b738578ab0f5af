"""Queries over page layout, answer spans and evaluation variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.operators import claims as K
from docweft.operators import layout, service, spans, variants
from docweft.plans.base import frame, relation, with_ctes
from docweft.plans import q_evidence  # noqa: F401  registers walk, attributed
from docweft.plans.q_retrieval import CHAIN, fuse_sql
from docweft.plans.q_scalars import QTERMS, sql_list, sql_tokens
from docweft.plans.registry import query
from docweft.session import durable, table

c = F.col

query(
    "order_regions",
    with_ctes(
        ("regions",),
        """SELECT page, region_id, col AS "column", band, row_number() OVER (PARTITION BY page ORDER BY band, col NULLS FIRST, y0, x0, region_id) - 1 AS place FROM (
        SELECT *, CASE WHEN two THEN count(*) FILTER (col IS NULL) OVER (PARTITION BY page ORDER BY y0, x0, region_id) ELSE 0 END::BIGINT AS band FROM (SELECT *, CASE WHEN two AND x1 <= 0.52 THEN 0 WHEN two AND x0 >= 0.48 THEN 1 END AS col FROM (
        SELECT r.*, coalesce(nl >= 2 AND nr >= 2 AND ends <= begins, false) AS two FROM regions r JOIN (SELECT page, count(*) FILTER (x1 <= 0.52) AS nl, count(*) FILTER (x0 >= 0.48) AS nr, max(x1) FILTER (x1 <= 0.52) AS ends, min(x0) FILTER (x0 >= 0.48) AS begins FROM regions GROUP BY page) USING (page))))""",
    ),
)(lambda s, f: layout.order_regions(frame("regions", s, f)))
GAP = "round(least(abs(a.y0 - b.y1), abs(b.y0 - a.y1)), 9)"
query("caption_link", with_ctes(("regions",), f"SELECT region_id, figure FROM (SELECT a.region_id, b.region_id AS figure, row_number() OVER (PARTITION BY a.region_id ORDER BY {GAP}, b.region_id) AS r FROM regions a JOIN regions b ON a.page = b.page AND a.kind = 'caption' AND b.kind IN ('figure', 'table') AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND {GAP} <= 0.08) WHERE r = 1"))(
    lambda s, f: layout.caption_link(frame("regions", s, f))
)
ASKED = "Which table is left of the small ring?"
query(
    "spatial_regions",
    with_ctes(("regions",), f"""SELECT page, region_id, value FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY value DESC, region_id) AS r FROM (SELECT page, region_id, (3 * len(list_intersect(['table', 'left', 'small', 'ring'], list_distinct({sql_tokens('text', '[a-z0-9][a-z0-9.%/-]*')}))) + (kind IN ('figure', 'table', 'caption'))::INT)::BIGINT AS value
    FROM regions WHERE x0 BETWEEN 0 AND 1 AND x1 BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x0 <= x1 AND y0 <= y1) WHERE value > 0) WHERE r <= 4"""),
)(lambda s, f: layout.spatial_regions(frame("regions", s, f).withColumn("words", F.array_distinct(T.content_tokens(c("text")))), F.lit(ASKED), F.array_distinct(T.content_tokens(F.lit(ASKED))), F.lit(ASKED).rlike(V.SPATIAL)))


# Span logits: words of benchmark items with start and end scores from their length and place.
@relation("logits", "SELECT question_id, i, w[i + 1] AS token, (length(w[i + 1]) * 7 + i * 13) % 29 / 4.0::DOUBLE AS s, (length(w[i + 1]) * 5 + i * 11) % 31 / 4.0::DOUBLE AS e FROM (SELECT item_id AS question_id, regexp_extract_all(text, '[^ ]+') AS w FROM benchmark), UNNEST(range(0, len(w))) AS t(i)")
def logits(spark, sf):
    words = table(spark, sf, "benchmark").select(c("item_id").alias("question_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("i", "token"))
    n = F.length("token")
    return words.select("question_id", c("i").cast("long").alias("i"), "token", (((n * 7 + c("i") * 13) % 29) / 4.0).alias("start"), (((n * 5 + c("i") * 11) % 31) / 4.0).alias("end"))


query(
    "extractive_span",
    with_ctes(
        ("logits",),
        """SELECT question_id, start_at, end_at, total, (SELECT string_agg(token, ' ' ORDER BY i) FROM logits x WHERE x.question_id = p.question_id AND x.i BETWEEN start_at AND end_at) AS answer FROM (
        SELECT a.question_id, a.i AS start_at, b.i AS end_at, round(a.s + b.e, 6) AS total FROM logits a JOIN logits b ON a.question_id = b.question_id AND b.i BETWEEN a.i AND a.i + 29 QUALIFY row_number() OVER (PARTITION BY a.question_id ORDER BY total DESC, a.i, b.i) = 1) p""",
    ),
)(lambda s, f: spans.joint_span(frame("logits", s, f)))
PIECES = "regexp_extract_all(s, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+')"


def novel_sql(source: str, keys: str = "question_id") -> str:
    """``keys, answer, confidence`` of ``source`` with ``question, evidence``: the longest new run of the sentence closest to the question."""
    return f"""SELECT {keys}, CASE WHEN v IS NULL OR v = 0 THEN '' WHEN n > 0 THEN regexp_replace(run, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g') ELSE s END AS answer, round(coalesce(v, 0), 6) AS confidence FROM (
        SELECT {keys}, v, s, run, len(regexp_extract_all(run, '[a-zA-Z0-9]+')) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, k) AS r FROM (SELECT {keys}, v, s, k, runs[k] AS run FROM (
        SELECT {keys}, v, s, string_split(array_to_string(list_transform({PIECES}, lambda p: CASE WHEN regexp_matches(p, '^[a-zA-Z0-9]') AND (list_contains({sql_list(V.QUERY_STOPWORDS)}, lower(p)) OR list_contains(t, lower(p))) THEN chr(1) ELSE p END), ''), chr(1)) AS runs FROM (
        SELECT {keys}, t, trim(ss[i]) AS s, CASE WHEN len(t) = 0 THEN 0 ELSE len(list_intersect(t, {sql_tokens('ss[i]')}))::DOUBLE / len(t) END AS v, row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, i) AS best
        FROM (SELECT {keys}, {QTERMS} AS t, list_filter(string_split(regexp_replace(evidence, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM {source}), UNNEST(range(1, len(ss) + 1)) AS u(i)) WHERE best = 1), UNNEST(range(1, len(runs) + 1)) AS u(k))) WHERE r = 1"""


query("novel_span_answer", with_ctes(("questions",), novel_sql("questions")))(lambda s, f: spans.novel_span(frame("questions", s, f)).select("question_id", "answer", "confidence"))


# Answers: a document whose id is divisible by 20 asks with its first line; its nearest vectors' documents answer with theirs.
relation("firsts", "SELECT doc_id, source, string_split(text, chr(10))[1] AS content FROM documents WHERE text IS NOT NULL")
relation("asking", "SELECT doc_id AS question_id, content AS question FROM firsts WHERE doc_id % 20 = 0", ("firsts",))
relation("retrieved", "SELECT d.question_id, d.chunk_id, k.source AS document_id, d.rank, d.score, k.content FROM dense d JOIN firsts k ON k.doc_id = d.chunk_id WHERE d.chunk_id <> d.question_id", ("dense", "firsts"))
relation("contexts", "SELECT question_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT *, sum(length(content)) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM retrieved) WHERE used <= 4000 GROUP BY 1", ("retrieved",))


def asking(spark, sf):
    """Questions, and the chunks that the dense stream finds for them."""
    firsts = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", F.get(F.split("text", "\n"), F.lit(0)).alias("content"))
    questions = firsts.where("doc_id % 20 = 0").select(c("doc_id").alias("question_id"), c("content").alias("question"))
    found = frame("dense", spark, sf).where("chunk_id <> question_id").join(firsts.select(c("doc_id").alias("chunk_id"), c("source").alias("document_id"), "content"), "chunk_id")
    return questions, durable(found.select("question_id", "chunk_id", "document_id", "rank", "score", "content"))


query(
    "rag_answer",
    with_ctes(
        ("asking", "retrieved", "contexts"),
        f"""SELECT m.question_id, coalesce(a.answer, '') AS answer, round(CASE WHEN m.read THEN coalesce(a.confidence, 0) WHEN m.first < 0.15 THEN greatest(m.first, 0) ELSE 0 END, 6) AS confidence,
        NOT m.read OR trim(coalesce(a.answer, '')) = '' OR (coalesce(a.confidence, 0) < 0.3 AND m.best < 0.5) AS insufficient, m.read AND trim(coalesce(a.answer, '')) <> '' AND contains(lower(m.context), lower(trim(coalesce(a.answer, '')))) AS grounded,
        coalesce(m.sources, 0) AS sources, coalesce(m.documents, 0) AS documents, coalesce(m.mean, 0) AS mean_score, round(coalesce(m.best, 0), 4) AS best_score
        FROM (SELECT *, coalesce(first >= 0.15 AND trim(context) <> '', false) AS read FROM asking LEFT JOIN (SELECT question_id, count(*) AS sources, count(DISTINCT document_id) AS documents, round(avg(score), 4) AS mean, max(score) AS best, min_by(score, rank) AS first FROM retrieved GROUP BY 1) USING (question_id)
          LEFT JOIN contexts USING (question_id)) m LEFT JOIN ({novel_sql("(SELECT question_id, question, context AS evidence FROM asking JOIN contexts USING (question_id))")}) a ON a.question_id = m.question_id AND m.read""",
    ),
)(lambda s, f: service.rag_answer(*asking(s, f), spans.novel_span))
query(
    "qa_rerank",
    with_ctes(
        ("asking", "retrieved"),
        f"""SELECT question_id, chunk_id, qa, row_number() OVER (PARTITION BY question_id ORDER BY qa DESC NULLS LAST, rank, chunk_id) AS place FROM retrieved JOIN asking USING (question_id) LEFT JOIN (SELECT question_id, chunk_id, confidence AS qa
        FROM ({novel_sql("(SELECT question_id, chunk_id, question, content AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id) AS r FROM retrieved JOIN asking USING (question_id)) WHERE r <= 8 AND trim(content) <> '')", "question_id, chunk_id")})) USING (question_id, chunk_id)""",
    ),
)(lambda s, f: _reranked(*asking(s, f)))


def _reranked(questions, found):
    return service.qa_rerank(found.join(questions, "question_id"), spans.novel_span)


# Retrieval as one plan: the route is a column of the questions, the graph is ready for three in four; graph and structure are walks from dense hits.
relation("paths_of", "SELECT DISTINCT question_id, CASE WHEN question_id // 20 % 4 = 0 THEN 'semantic' WHEN question_id // 20 % 3 = 0 THEN 'graph' WHEN question_id // 20 % 3 = 1 THEN 'semantic' ELSE 'both' END AS path FROM dense", ("dense",))
for _name, _stream, _path in (("d_text", "dense", "graph"), ("l_text", "lexical", "graph"), ("s_text", "walk", "graph"), ("g_graph", "walk", "semantic")):
    relation(_name, f"SELECT s.question_id, s.chunk_id, s.rank FROM {_stream} s JOIN paths_of p ON p.question_id = s.question_id AND p.path <> '{_path}'", (_stream, "paths_of"))
relation("hybrid_text", fuse_sql("d_text", "l_text", 1.0, 1.0, None, 20), ("d_text", "l_text"))
relation("text_paths", fuse_sql("hybrid_text", "s_text", 0.7, 0.3, 8, 20), ("hybrid_text", "s_text"))
query("retrieve_evidence", with_ctes(("text_paths", "g_graph"), f"SELECT question_id, path, chunk_id, rank AS place FROM ({fuse_sql('text_paths', 'g_graph', 0.5, 0.5, None, 5)}) JOIN paths_of USING (question_id)"))(lambda s, f: _retrieved(s, f))


def _retrieved(spark, sf):
    streams = {name: durable(frame(name, spark, sf).select("question_id", "chunk_id", "rank")) for name in ("dense", "lexical", "walk")}
    turn = F.floor(c("question_id") / 20)
    questions = streams["dense"].select("question_id").distinct().select("question_id", F.when(turn % 3 == 0, "graph").when(turn % 3 == 1, "semantic").alias("route"), F.when(turn % 4 != 0, "available").alias("graph_state"))
    return service.retrieve_evidence(questions, streams["dense"], streams["lexical"], streams["walk"], streams["walk"])


# Evidence of one document: a customer's dearest orders are structural hits in the element tree; orders divisible by 7 lie in another document.
query(
    "fuse_document_evidence",
    with_ctes(
        ("dense", "ranked", "tree"),
        f"""SELECT question_id, stream, id, context, row_number() OVER (PARTITION BY question_id ORDER BY stream, r) AS place FROM (SELECT question_id, 0 AS stream, chunk_id::VARCHAR AS id, NULL::VARCHAR AS context, row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id::VARCHAR) AS r FROM dense QUALIFY r <= 8
        UNION ALL SELECT question_id, 1, 'o' || item, context, row_number() OVER (PARTITION BY question_id ORDER BY rank, 'o' || item) AS r FROM ranked LEFT JOIN (SELECT node, string_agg(ancestor, ' > ' ORDER BY depth DESC) AS context FROM ({CHAIN}) GROUP BY 1) ON node = 'o' || item WHERE question_id % 20 = 0 AND item % 7 <> 0 QUALIFY r <= 8) QUALIFY place <= 12""",
    ),
)(lambda s, f: _fused_document(s, f))


def _fused_document(spark, sf):
    order = F.concat(F.lit("o"), c("item").cast("string"))
    asked = frame("ranked", spark, sf).where("question_id % 20 = 0").select("question_id", F.lit(1).alias("document_id"), order.alias("element_id"), "rank")
    other = c("id").startswith("o") & (F.substring("id", 2, 20).cast("long") % 7 == 0)
    elements = frame("tree", spark, sf).select(F.when(other, 2).otherwise(1).alias("document_id"), c("id").alias("element_id"), "parent_id", c("id").alias("heading"))
    return service.fuse_document_evidence(asked, frame("dense", spark, sf).select("question_id", c("chunk_id").cast("string").alias("id"), "rank"), elements)


# Points and repair: benchmark items ask or answer; their evidence is every line that holds most of their words.
def _evidence(spark, sf, key):
    found = frame("attributed", spark, sf).select(c("claim_id").alias(key), c("block_id").alias("block"))
    return K.evidence(found, frame("lines", spark, sf).select(c("chunk_id").alias("block"), "content"), key)


def support_points(spark, sf):
    marks = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(15)), (c("question_id") % 3 + 1).cast("int"))
    return service.support_points(frame("questions", spark, sf).select("question_id", "question", F.lit("").alias("answer"), marks.alias("marks")), _evidence(spark, sf, "question_id"))


query("support_points")(support_points)


def retain_supported(spark, sf):
    items = table(spark, sf, "benchmark").select(c("item_id").alias("answer_id"), F.posexplode(T.sentences(c("text"))).alias("place", "claim"))
    claims = items.select(F.concat_ws(":", "answer_id", "place").alias("claim_id"), "answer_id", "place", "claim", F.lit(None).cast("string").alias("question"), F.array().cast("array<bigint>").alias("stated"))
    return service.retain_supported(claims, _evidence(spark, sf, "answer_id"))


query("retain_supported")(retain_supported)


# Variants: a document whose id is divisible by 20 asks with its first line about its own lines; every line is a chunk and an element, whose
# parent is the line at the start of its ten; section and heading are the words of that line.
ELEMENTS = "SELECT document_id, chunk_id, content, chunk_index AS seq, chunk_id - chunk_index % 10 AS top FROM lines WHERE document_id % 20 = 0"
relation("evaluated", f"SELECT e.*, h.content AS heading FROM ({ELEMENTS}) e JOIN lines h ON h.chunk_id = e.top", ("lines",))
relation("wanted", f"SELECT question_id, {QTERMS} AS t FROM (SELECT doc_id AS question_id, string_split(text, chr(10))[1] AS question FROM documents WHERE doc_id % 20 = 0)")
relation("rated", f"SELECT question_id, chunk_id, top, seq, CASE WHEN len(t) = 0 THEN 0 ELSE round(len(list_intersect(t, {sql_tokens('content')}))::DOUBLE / len(t), 6) END AS cs, CASE WHEN len(t) = 0 THEN 0 ELSE round(0.7 * (len(list_intersect(t, {sql_tokens('content')}))::DOUBLE / len(t)) + 0.3 * (len(list_intersect(t, {sql_tokens('heading')}))::DOUBLE / len(t)), 6) END AS es, heading FROM evaluated JOIN wanted ON question_id = document_id", ("evaluated", "wanted"))
VARIANTS = """SELECT variant, question_id, place, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY variant, question_id ORDER BY o, id) AS place FROM (
  WITH a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cs DESC, seq, chunk_id) AS r FROM rated), b AS (SELECT * FROM a WHERE r <= 5 AND cs > 0), e AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY es DESC, seq, chunk_id) AS r FROM rated WHERE es > 0 QUALIFY r <= 5)
  SELECT 'A' AS variant, question_id, r AS o, 'chunk' AS kind, chunk_id AS id FROM a WHERE r <= 5
  UNION ALL SELECT 'B', question_id, 2 * r, 'chunk', chunk_id FROM b
  UNION ALL SELECT 'B', question_id, 2 * row_number() OVER (PARTITION BY question_id ORDER BY seq, chunk_id) + 1, 'chunk', chunk_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.question_id = a.question_id AND b.heading = a.heading) AND NOT EXISTS (SELECT 1 FROM b WHERE b.question_id = a.question_id AND b.chunk_id = a.chunk_id)
  UNION ALL SELECT 'C', question_id, r, 'element', chunk_id FROM e
  UNION ALL SELECT 'C', question_id, min(r) + 5, 'element', top FROM e WHERE top <> chunk_id AND NOT EXISTS (SELECT 1 FROM e x WHERE x.question_id = e.question_id AND x.chunk_id = e.top) GROUP BY question_id, top
  UNION ALL SELECT 'D', question_id, r, 'chunk', chunk_id FROM b UNION ALL SELECT 'D', question_id, r + 5, 'element', chunk_id FROM e)) WHERE place <= 5"""


def struct_eval_variants(spark, sf):
    rows = frame("lines", spark, sf)
    own = rows.where("document_id % 20 = 0").withColumn("top", c("chunk_id") - c("chunk_index") % 10).join(rows.select(c("chunk_id").alias("top"), c("content").alias("heading")), "top")
    chunks = own.select("document_id", "chunk_id", c("chunk_id").alias("element_id"), "content", c("chunk_index").alias("seq"), c("heading").alias("section"))
    elements = own.select("document_id", c("chunk_id").alias("element_id"), F.when(c("top") != c("chunk_id"), c("top")).alias("parent_id"), "content", c("chunk_index").alias("seq"), "heading")
    asked = table(spark, sf, "documents").where("doc_id % 20 = 0").select(c("doc_id").alias("question_id"), c("doc_id").alias("document_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("question"))
    return variants.run(variants.VARIANTS, variants.relations(asked, chunks, elements))


query("struct_eval_variants", with_ctes(("rated",), VARIANTS))(struct_eval_variants)
