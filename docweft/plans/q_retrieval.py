"""Retrieval, fusion, graph and context queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.operators import folds, fulltext, graph, retrieve
from docweft.plans.base import frame, relation, with_ctes
from docweft.plans.q_scalars import sql_list, sql_stem, sql_tokens
from docweft.plans.registry import query
from docweft.session import durable, table

c = F.col

EDGES = """SELECT DISTINCT document_id, source, target, relation, weight FROM (
  WITH n AS (SELECT document_id, chunk_id AS a, page AS pa, topic AS ta, lead(chunk_id) OVER w AS b, lead(page) OVER w AS pb, lead(topic) OVER w AS tb, lead(chunk_id, 2) OVER w AS d, lead(topic, 2) OVER w AS td
    FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id))
  SELECT document_id, a AS source, b AS target, 'NEXT' AS relation, 1.0::DOUBLE AS weight FROM n WHERE b IS NOT NULL UNION ALL SELECT document_id, b, a, 'PREV', 1.0 FROM n WHERE b IS NOT NULL
  UNION ALL SELECT document_id, a, b, 'SAME_PAGE', 0.7 FROM n WHERE pa = pb UNION ALL SELECT document_id, b, a, 'SAME_PAGE', 0.7 FROM n WHERE pa = pb
  UNION ALL SELECT document_id, a, b, 'SAME_SECTION', 0.5 FROM n WHERE ta = tb UNION ALL SELECT document_id, b, a, 'SAME_SECTION', 0.5 FROM n WHERE ta = tb
  UNION ALL SELECT document_id, a, d, 'SAME_SECTION', 0.5 FROM n WHERE ta = td UNION ALL SELECT document_id, d, a, 'SAME_SECTION', 0.5 FROM n WHERE ta = td)"""


@relation("edges", EDGES, ("chunks",))
def edges(spark, sf):
    return graph.plan_edges(frame("chunks", spark, sf))


#: Query vectors of the dense streams: every vector whose id is divisible by 20.
@relation("dense", """SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 20""")
def dense(spark, sf, most=20):
    e = table(spark, sf, "embeddings")
    return retrieve.dense_topk(e.where("vec_id % 20 = 0").select(c("vec_id").alias("question_id"), c("embedding").alias("q")), e.select(c("vec_id").alias("chunk_id"), c("embedding").alias("v")), most)


#: Lexical stream: all words of all documents. Questions, for every id divisible by 20, are web searches over the words of a
#: document's first line: all words, a phrase or a word, a word without another, a phrase or two words.
@relation("searches", f"""SELECT doc_id AS question_id, CASE (doc_id // 20) % 4 WHEN 0 THEN w1 || ' ' || w2 WHEN 1 THEN '"' || w2 || ' ' || w3 || '" or ' || w1 WHEN 2 THEN w1 || ' -' || w4 ELSE '"' || w1 || ' ' || w2 || '" or ' || w3 || ' ' || w5 END AS question
  FROM (SELECT doc_id, {", ".join(f"coalesce(w[{i}], '') AS w{i}" for i in range(1, 6))} FROM (SELECT doc_id, {sql_tokens('string_split(text, chr(10))[1]')} AS w FROM documents WHERE doc_id % 20 = 0))""")
def searches(spark, sf):
    words = table(spark, sf, "documents").where("doc_id % 20 = 0").select("doc_id", T.alnum_tokens(F.get(F.split("text", "\n"), F.lit(0))).alias("w"))
    w = [F.coalesce(F.get("w", F.lit(i)), F.lit("")) for i in range(5)]
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else w[p] for p in parts])
    form = F.floor(c("doc_id") / 20) % 4
    question = F.when(form == 0, said(0, " ", 1)).when(form == 1, said('"', 1, " ", 2, '" or ', 0)).when(form == 2, said(0, " -", 3)).otherwise(said('"', 0, " ", 1, '" or ', 2, " ", 4))
    return words.select(c("doc_id").alias("question_id"), question.alias("question"))


STOP = f"list_contains({sql_list(V.QUERY_STOPWORDS)}, w)"
relation("ft_units", f"""SELECT *, count(*) OVER (PARTITION BY question_id, unit) AS size FROM (SELECT question_id, alt, unit, excluded, place, {sql_stem('w')} AS lexeme FROM (
  SELECT question_id, alt, unit, excluded, i AS place, ws[i] AS w FROM (SELECT question_id, unit, part[1] = '-' AS excluded, part, {sql_tokens('part')} AS ws, count(*) FILTER (part = 'or') OVER (PARTITION BY question_id ORDER BY unit) AS alt
    FROM (SELECT question_id, u AS unit, ps[u] AS part FROM (SELECT question_id, regexp_extract_all(lower(question), '-?"[^"]*"|[^\\s"]+') AS ps FROM searches), UNNEST(range(1, len(ps) + 1)) AS t(u))), UNNEST(range(1, len(ws) + 1)) AS t(i) WHERE part <> 'or') WHERE NOT {STOP})""", ("searches",))
relation("ft_words", f"SELECT chunk_id, pos, {sql_stem('w')} AS lexeme FROM (SELECT doc_id AS chunk_id, i AS pos, ws[i] AS w FROM (SELECT doc_id, {sql_tokens('text')} AS ws FROM documents), UNNEST(range(1, len(ws) + 1)) AS t(i)) WHERE NOT {STOP}")
relation("ft_stands", "SELECT question_id, chunk_id, unit, min(pos) AS s, max(pos) AS e FROM ft_units JOIN ft_words USING (lexeme) GROUP BY question_id, chunk_id, unit, pos - place, size HAVING count(*) = size", ("ft_units", "ft_words"))
relation("ft_fit", """SELECT DISTINCT question_id, chunk_id FROM (SELECT question_id, alt, chunk_id, count(DISTINCT unit) FILTER (NOT excluded) AS has, count(*) FILTER (excluded) AS bad FROM ft_stands JOIN (SELECT DISTINCT question_id, alt, unit, excluded FROM ft_units) USING (question_id, unit) GROUP BY ALL)
  JOIN (SELECT question_id, alt, count(DISTINCT unit) FILTER (NOT excluded) AS needs FROM ft_units GROUP BY ALL) USING (question_id, alt) WHERE has = needs AND bad = 0""", ("ft_units", "ft_stands"))
relation("ft_held", "SELECT * FROM ft_stands SEMI JOIN ft_fit USING (question_id, chunk_id) SEMI JOIN (SELECT question_id, unit FROM ft_units WHERE NOT excluded) USING (question_id, unit)", ("ft_units", "ft_stands", "ft_fit"))
relation("ft_covers", """SELECT question_id, chunk_id, s, min(e) AS e FROM (SELECT question_id, chunk_id, e, max(s) AS s FROM (SELECT question_id, chunk_id, alt, e, min(last) AS s FROM (
  SELECT question_id, chunk_id, alt, e, max(s) OVER (PARTITION BY question_id, chunk_id, alt, unit ORDER BY e) AS last FROM (SELECT DISTINCT question_id, chunk_id, e FROM ft_held) JOIN (SELECT DISTINCT question_id, alt, unit FROM ft_units WHERE NOT excluded) USING (question_id) LEFT JOIN ft_held USING (question_id, chunk_id, unit, e))
  GROUP BY ALL HAVING count(*) = count(last)) GROUP BY ALL) GROUP BY ALL""", ("ft_units", "ft_held"))
relation("ft_places", """SELECT question_id, chunk_id, pos, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY pos) AS n FROM (SELECT DISTINCT question_id, chunk_id, s + place - low AS pos
  FROM ft_held JOIN (SELECT DISTINCT question_id, unit, place, min(place) OVER (PARTITION BY question_id, unit) AS low FROM ft_units) USING (question_id, unit))""", ("ft_units", "ft_held"))


@relation("lexical", """SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT c.question_id, c.chunk_id, round(sum(0.1::DOUBLE / (1 + c.e - c.s - (b.n - a.n))), 6) AS score FROM ft_covers c
  JOIN ft_places a ON a.question_id = c.question_id AND a.chunk_id = c.chunk_id AND a.pos = c.s JOIN ft_places b ON b.question_id = c.question_id AND b.chunk_id = c.chunk_id AND b.pos = c.e GROUP BY ALL) QUALIFY rank <= 20""", ("ft_covers", "ft_places"))
def lexical(spark, sf, most=20):
    asked = durable(fulltext.units(frame("searches", spark, sf)))
    return fulltext.find(asked, table(spark, sf, "documents").select(c("doc_id").alias("chunk_id"), c("text").alias("content")), most)


def both(spark, sf):
    """The dense and the lexical stream, each computed once and written."""
    return tuple(durable(frame(name, spark, sf).select("question_id", "chunk_id", "rank")) for name in ("dense", "lexical"))


def on_both(spark, sf, plan):
    """``plan`` on both streams, each computed once."""
    return plan(*both(spark, sf))


def fuse_sql(a: str, b: str, w1: float, w2: float, digits: int | None, most: int, k: int = 60) -> str:
    s = f"coalesce({w1} / ({k} + x.rank), 0::DOUBLE) + coalesce({w2} / ({k} + y.rank), 0::DOUBLE)"
    s = f"round({s}, {digits})" if digits else s
    return f"""SELECT question_id, chunk_id, round(fusion_score, 9) AS fusion_score, paths, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fusion_score DESC, chunk_id) AS rank FROM (
      SELECT question_id, chunk_id, {s} AS fusion_score, (CASE WHEN x.rank IS NULL THEN 0 ELSE 1 END + CASE WHEN y.rank IS NULL THEN 0 ELSE 2 END)::BIGINT AS paths FROM {a} x FULL JOIN {b} y USING (question_id, chunk_id))) WHERE rank <= {most}"""


def fused(frame_, digits=9):
    return frame_.select("question_id", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), "paths", "rank")


query("dense_topk", with_ctes(("dense",), "SELECT * FROM dense WHERE rank <= 10"))(lambda s, f: frame("dense", s, f).where("rank <= 10"))
query("semantic_search_api", with_ctes((), """SELECT vec_id AS chunk_id, score FROM (SELECT v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY score DESC, chunk_id LIMIT 20"""))(
    lambda s, f: retrieve.dense_topk(table(s, f, "embeddings").orderBy("vec_id").limit(1).select(F.lit(0).alias("question_id"), c("embedding").alias("q")), table(s, f, "embeddings").select(c("vec_id").alias("chunk_id"), c("embedding").alias("v")), 20, 4).select("chunk_id", "score")
)
query("cosine", with_ctes((), "SELECT v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS value FROM embeddings v JOIN embeddings q ON q.vec_id = v.vec_id // 2"))(
    lambda s, f: table(s, f, "embeddings").select(c("vec_id").alias("chunk_id"), c("embedding").alias("v"), F.floor(c("vec_id") / 2).alias("qid")).join(table(s, f, "embeddings").select(c("vec_id").alias("qid"), c("embedding").alias("q")), "qid").select("chunk_id", F.round(retrieve.dot(retrieve.unit(c("q")), retrieve.unit(c("v"))), 6).alias("value"))
)
query("lexical_search", with_ctes(("lexical",), "SELECT * FROM lexical"))(lambda s, f: frame("lexical", s, f))
query("hybrid_rrf", with_ctes(("dense", "lexical"), fuse_sql("dense", "lexical", 1.0, 1.0, None, 40)))(lambda s, f: fused(retrieve.rrf([(x, 1.0) for x in both(s, f)], most=40)))
query("hybrid_pool_sizing", with_ctes((), "SELECT item_id AS question_id, least(20, item_id % 30 + 1)::BIGINT AS out, least(40, greatest(20, 3 * (item_id % 9), least(20, item_id % 30 + 1)))::BIGINT AS candidate_k FROM benchmark"))(
    lambda s, f: table(s, f, "benchmark").select(c("item_id").alias("question_id"), F.least(F.lit(20), c("item_id") % 30 + 1).cast("long").alias("out"), F.least(F.lit(40), F.greatest(F.lit(20), 3 * (c("item_id") % 9), F.least(F.lit(20), c("item_id") % 30 + 1))).cast("long").alias("candidate_k"))
)
query("dual_path_rrf", with_ctes(("dense", "lexical"), fuse_sql("dense", "lexical", 0.7, 0.3, 8, 10)))(lambda s, f: fused(retrieve.rrf(list(zip(both(s, f), (0.7, 0.3), strict=True)), digits=8, most=10)))
query("graph_primary_fuse", with_ctes(("dense", "lexical"), fuse_sql("dense", "lexical", 0.5, 0.5, None, 20)))(lambda s, f: fused(retrieve.rrf([(x, 0.5) for x in both(s, f)], most=20)))
query("rrf_outer", with_ctes(("dense", "lexical"), "SELECT question_id, chunk_id, x.rank AS dense_rank, y.rank AS lexical_rank FROM dense x FULL JOIN lexical y USING (question_id, chunk_id)"))(
    lambda s, f: on_both(s, f, lambda d, l: d.withColumnRenamed("rank", "dense_rank").join(l.withColumnRenamed("rank", "lexical_rank"), ["question_id", "chunk_id"], "full"))
)
INTERLEAVE = "SELECT question_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, stream, chunk_id) AS place FROM (SELECT question_id, chunk_id, min(rank) AS rank, min_by(stream, rank * 2 + stream) AS stream FROM (SELECT question_id, chunk_id, rank, 0 AS stream FROM dense UNION ALL SELECT question_id, chunk_id, rank, 1 FROM lexical) GROUP BY 1, 2)) WHERE place <= 8"


def interleave(spark, sf, most=8):
    d, l = both(spark, sf)
    best = d.withColumn("stream", F.lit(0)).unionByName(l.withColumn("stream", F.lit(1))).groupBy("question_id", "chunk_id").agg(F.min(F.struct("rank", "stream")).alias("b"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("b.rank", "b.stream", "chunk_id")).cast("long")
    return best.withColumn("place", place).where(c("place") <= most).select("question_id", "chunk_id", "place")


query("round_robin_interleave", with_ctes(("dense", "lexical"), INTERLEAVE))(interleave)
query("visual_text_interleave", with_ctes(("dense", "lexical"), INTERLEAVE.replace("place <= 8", "place <= 12")))(lambda s, f: interleave(s, f, 12))
query("rank_within_stream", with_ctes(("dense",), "SELECT question_id, chunk_id, rank FROM dense"))(lambda s, f: frame("dense", s, f).select("question_id", "chunk_id", "rank"))
query("concat_streams", with_ctes(("dense", "lexical"), "SELECT question_id, chunk_id, 0::BIGINT AS stream, rank FROM dense UNION ALL SELECT question_id, chunk_id, 1, rank FROM lexical"))(
    lambda s, f: on_both(s, f, lambda d, l: d.withColumn("stream", F.lit(0).cast("long")).unionByName(l.withColumn("stream", F.lit(1).cast("long"))))
)
STREAMS = "SELECT question_id, chunk_id, 0::BIGINT AS stream, rank FROM dense UNION ALL SELECT question_id, chunk_id, 1, rank FROM lexical"
query("topk_per_stream", with_ctes(("dense", "lexical"), f"SELECT question_id, stream, chunk_id, rank, greatest(count(*) OVER (PARTITION BY question_id, stream) - 5, 0) AS truncated FROM ({STREAMS}) QUALIFY rank <= 5"))(
    lambda s, f: on_both(s, f, lambda d, l: _streams(d, l).withColumn("truncated", F.greatest(F.count(F.lit(1)).over(Window.partitionBy("question_id", "stream")) - 5, F.lit(0))).where("rank <= 5"))
)
query("identity_dedupe", with_ctes(("dense", "lexical"), f"SELECT question_id, chunk_id, min(stream) AS stream, min_by(rank, stream) AS rank, count(*) - 1 AS duplicates FROM ({STREAMS}) GROUP BY 1, 2"))(
    lambda s, f: on_both(s, f, lambda d, l: _streams(d, l).groupBy("question_id", "chunk_id").agg(F.min("stream").alias("stream"), F.min_by("rank", "stream").alias("rank"), (F.count(F.lit(1)) - 1).alias("duplicates")))
)


def _streams(d, l):
    """Both streams, the dense one first."""
    return d.withColumn("stream", F.lit(0).cast("long")).unionByName(l.withColumn("stream", F.lit(1).cast("long")))


query("fuse_evidence", with_ctes(("dense", "lexical"), "SELECT question_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY stream, rank, chunk_id) AS place FROM (SELECT question_id, chunk_id, min(stream) AS stream, min_by(rank, stream) AS rank FROM (SELECT question_id, chunk_id, rank, 0 AS stream FROM dense WHERE rank <= 8 UNION ALL SELECT question_id, chunk_id, rank, 1 FROM lexical WHERE rank <= 8) GROUP BY 1, 2)) WHERE place <= 12"))(
    lambda s, f: on_both(s, f, lambda d, l: d.where("rank <= 8").withColumn("stream", F.lit(0)).unionByName(l.where("rank <= 8").withColumn("stream", F.lit(1))).groupBy("question_id", "chunk_id").agg(F.min(F.struct("stream", "rank")).alias("b")).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("b.stream", "b.rank", "chunk_id")).cast("long")).where("place <= 12").select("question_id", "chunk_id", "place"))
)
query("augment_structure", with_ctes(("dense", "lexical"), "SELECT question_id, chunk_id FROM dense WHERE rank <= 10 UNION ALL SELECT question_id, chunk_id FROM lexical l WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.question_id = l.question_id AND d.chunk_id = l.chunk_id AND d.rank <= 10)"))(
    lambda s, f: on_both(s, f, lambda d, l: d.where("rank <= 10").drop("rank").unionByName(l.drop("rank").join(d.where("rank <= 10"), ["question_id", "chunk_id"], "left_anti")))
)
query("order_bands", with_ctes(("dense", "lexical"), "SELECT question_id, chunk_id, band, row_number() OVER (PARTITION BY question_id ORDER BY band, rank, chunk_id) AS place FROM (SELECT question_id, chunk_id, rank, 0::BIGINT AS band FROM dense WHERE rank <= 5 UNION ALL SELECT question_id, chunk_id, rank, 1 FROM lexical WHERE rank <= 2)"))(
    lambda s, f: on_both(s, f, lambda d, l: d.where("rank <= 5").withColumn("band", F.lit(0).cast("long")).unionByName(l.where("rank <= 2").withColumn("band", F.lit(1).cast("long"))).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("band", "rank", "chunk_id")).cast("long")).drop("rank"))
)
query("select_evidence", with_ctes(("dense",), "SELECT question_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, chunk_id) AS place FROM (SELECT question_id, chunk_id, round(1.0::DOUBLE / (rank + 1) + 0.15::DOUBLE * score, 9) AS s FROM (SELECT d.*, row_number() OVER (PARTITION BY question_id, label ORDER BY rank) AS per FROM dense d JOIN embeddings e ON e.vec_id = d.chunk_id) WHERE per = 1)) WHERE place <= 6"))(
    lambda s, f: frame("dense", s, f).join(table(s, f, "embeddings").select(c("vec_id").alias("chunk_id"), "label"), "chunk_id").withColumn("per", F.row_number().over(Window.partitionBy("question_id", "label").orderBy("rank"))).where("per = 1").withColumn("s", F.round(1.0 / (c("rank") + 1) + 0.15 * c("score"), 9)).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("s"), "chunk_id")).cast("long")).where("place <= 6").select("question_id", "chunk_id", "place")
)
query("searchable_filter", with_ctes((), "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5) AND embedding IS NOT NULL"))(lambda s, f: table(s, f, "embeddings").where(c("label").isin(1, 3, 5) & c("embedding").isNotNull()).select("vec_id", "label"))
query("owner_filter", with_ctes((), "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'"))(lambda s, f: table(s, f, "documents").where("source = 'src3'").select("doc_id", "lang", "n_chars"))
query("or_contains_filter", with_ctes(("lines",), "SELECT chunk_id, ((contains(lower(content), 'ment'))::INT + (contains(lower(content), 'heit'))::INT + (contains(lower(content), 'tion'))::INT)::BIGINT AS matched FROM lines WHERE contains(lower(content), 'ment') OR contains(lower(content), 'heit') OR contains(lower(content), 'tion')"))(
    lambda s, f: frame("lines", s, f).withColumn("matched", F.size(F.filter(F.array(F.lit("ment"), F.lit("heit"), F.lit("tion")), lambda t: F.lower(c("content")).contains(t))).cast("long")).where("matched > 0").select("chunk_id", "matched")
)
query("section_seeds", with_ctes(("lines",), "SELECT owner, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY m DESC, chunk_id) AS place FROM (SELECT owner, chunk_id, (contains(lower(content), 'tion'))::INT + (contains(lower(content), 'que'))::INT AS m FROM lines) WHERE m > 0) WHERE place <= 15"))(
    lambda s, f: frame("lines", s, f).withColumn("m", F.lower("content").contains("tion").cast("int") + F.lower("content").contains("que").cast("int")).where("m > 0").withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("m"), "chunk_id")).cast("long")).where("place <= 15").select("owner", "chunk_id", "place")
)
query("element_seeds", with_ctes(("paths",), "SELECT doc_id FROM paths WHERE contains(lower(heading), 'part 5') OR contains(lower(heading), 'src7')"))(lambda s, f: frame("paths", s, f).where(F.lower("heading").contains("part 5") | F.lower("heading").contains("src7")).select("doc_id"))

# Graph
query("plan_edges", with_ctes(("edges",), "SELECT * FROM edges"))(lambda s, f: frame("edges", s, f))
for _rel, _name in (("NEXT','PREV", "next_prev_edges"), ("SAME_PAGE", "same_page_edges"), ("SAME_SECTION", "same_section_edges")):
    query(_name, with_ctes(("edges",), f"SELECT source, target, relation FROM edges WHERE relation IN ('{_rel}')"))(lambda s, f, _rel=_rel: frame("edges", s, f).where(f"relation IN ('{_rel}')").select("source", "target", "relation"))
SEEDS = "SELECT chunk_id AS seed, chunk_id AS node FROM chunks WHERE chunk_id % 20 = 0"
seeds = lambda s, f: frame("chunks", s, f).where("chunk_id % 20 = 0").select(c("chunk_id").alias("seed"), c("chunk_id").alias("node"))
EXPAND = f"""SELECT seed, node, hops, weight FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, weight DESC, node) AS r FROM (
  SELECT seed, node, min(hops)::INTEGER AS hops, max_by(weight, -hops * 10 + weight) AS weight FROM (
    SELECT seed, node, 0 AS hops, 1.0::DOUBLE AS weight FROM ({SEEDS}) UNION ALL SELECT s.seed, e.target, 1, e.weight FROM ({SEEDS}) s JOIN edges e ON e.source = s.node
    UNION ALL SELECT s.seed, g.target, 2, g.weight FROM ({SEEDS}) s JOIN edges e ON e.source = s.node JOIN edges g ON g.source = e.target) GROUP BY 1, 2)) WHERE r <= 40"""
query("graph_expand", with_ctes(("chunks", "edges"), EXPAND))(lambda s, f: graph.expand(seeds(s, f), frame("edges", s, f), 2, 40))
query("structural_candidates", with_ctes(("chunks", "edges"), f"SELECT seed, node, hops, CASE WHEN hops = 0 THEN 1.0::DOUBLE ELSE round(weight / (1 + hops), 6) END AS structural_score FROM ({EXPAND}) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN hops = 0 THEN 1.0::DOUBLE ELSE round(weight / (1 + hops), 6) END DESC, node) <= 15"))(
    lambda s, f: graph.expand(seeds(s, f), frame("edges", s, f), 2, 40).withColumn("structural_score", F.when(c("hops") == 0, 1.0).otherwise(F.round(c("weight") / (1 + c("hops")), 6))).withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("structural_score"), "node"))).where("r <= 15").select("seed", "node", "hops", "structural_score")
)
NEIGH = f"""SELECT seed, chunk_id, ['NEXT', 'PREV', 'SAME_PAGE', 'SAME_SECTION'][p + 1] AS relation, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY p, chunk_id) AS rank FROM (
  SELECT s.seed, e.target AS chunk_id, min(CASE relation WHEN 'NEXT' THEN 0 WHEN 'PREV' THEN 1 WHEN 'SAME_PAGE' THEN 2 ELSE 3 END) AS p FROM ({SEEDS}) s JOIN edges e ON e.source = s.node WHERE e.target <> s.seed GROUP BY 1, 2)) WHERE rank <= 6"""
query("expand_neighbours", with_ctes(("chunks", "edges"), NEIGH))(lambda s, f: graph.neighbours(seeds(s, f), frame("edges", s, f), 6))
query("expand_long_form", with_ctes(("chunks", "edges"), NEIGH.replace("rank <= 6", "rank <= 4")))(lambda s, f: graph.neighbours(seeds(s, f), frame("edges", s, f), 4))
query("min_by_best_row", with_ctes(("edges",), "SELECT target, min(source) AS source FROM edges e WHERE weight = (SELECT max(weight) FROM edges x WHERE x.target = e.target) GROUP BY 1"))(lambda s, f: frame("edges", s, f).groupBy("target").agg(F.min_by("source", F.struct(-c("weight"), c("source"))).alias("source")))
query("edge_owner_join", with_ctes(("chunks", "edges"), "SELECT e.source, e.target, e.relation FROM edges e JOIN chunks k ON k.chunk_id = e.target WHERE k.owner = 'u1' AND e.source IN (SELECT chunk_id FROM chunks WHERE chunk_id % 20 = 0)"))(
    lambda s, f: frame("edges", s, f).join(frame("chunks", s, f).where("owner = 'u1'").select(c("chunk_id").alias("target")), "target").join(seeds(s, f).select(c("node").alias("source")), "source", "left_semi").select("source", "target", "relation")
)
TREE = """SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders"""


@relation("tree", TREE)
def tree(spark, sf):
    """Element tree: region, nation, customer, order."""
    k = lambda p, x: F.concat(F.lit(p), c(x).cast("string"))
    parts = [table(spark, sf, t).select(k(p, i).alias("id"), (k(q, j) if q else F.lit(None).cast("string")).alias("parent_id")) for t, p, i, q, j in (("region", "r", "r_regionkey", "", ""), ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


query("direct_children", with_ctes(("tree",), "SELECT id FROM tree WHERE parent_id = 'n3'"))(lambda s, f: frame("tree", s, f).where("parent_id = 'n3'").select("id"))
CHAIN = "SELECT a.id AS node, b.id AS ancestor, 1 AS depth FROM tree a JOIN tree b ON b.id = a.parent_id WHERE a.id LIKE 'o%' UNION ALL SELECT a.id, d.id, 2 FROM tree a JOIN tree b ON b.id = a.parent_id JOIN tree d ON d.id = b.parent_id WHERE a.id LIKE 'o%' UNION ALL SELECT a.id, e.id, 3 FROM tree a JOIN tree b ON b.id = a.parent_id JOIN tree d ON d.id = b.parent_id JOIN tree e ON e.id = d.parent_id WHERE a.id LIKE 'o%'"
orders_ = lambda s, f: frame("tree", s, f).where("id LIKE 'o%'").select(c("id").alias("node"))
query("parent_chain", with_ctes(("tree",), CHAIN))(lambda s, f: graph.ancestors(orders_(s, f), frame("tree", s, f)))
query("parent_self_join", with_ctes(("tree",), "SELECT a.id, b.id AS parent FROM tree a JOIN tree b ON a.parent_id = b.id"))(lambda s, f: frame("tree", s, f).alias("a").join(frame("tree", s, f).alias("b"), F.expr("a.parent_id = b.id")).select("a.id", c("b.id").alias("parent")))
DESC = "SELECT a.id AS root, b.id, 1 AS depth FROM tree a JOIN tree b ON b.parent_id = a.id WHERE a.id LIKE 'r%' UNION ALL SELECT a.id, d.id, 2 FROM tree a JOIN tree b ON b.parent_id = a.id JOIN tree d ON d.parent_id = b.id WHERE a.id LIKE 'r%' UNION ALL SELECT a.id, e.id, 3 FROM tree a JOIN tree b ON b.parent_id = a.id JOIN tree d ON d.parent_id = b.id JOIN tree e ON e.parent_id = d.id WHERE a.id LIKE 'r%'"
roots = lambda s, f: frame("tree", s, f).where("id LIKE 'r%'").select(c("id").alias("root"))
query("descendants", with_ctes(("tree",), f"SELECT root, id, depth FROM ({DESC}) "))(lambda s, f: graph.descendants(roots(s, f), frame("tree", s, f)))
query("element_expand", with_ctes(("tree",), f"SELECT root, id, depth FROM ({DESC}) WHERE depth <= 2"))(lambda s, f: graph.descendants(roots(s, f), frame("tree", s, f), 2))
query("structural_neighbourhood", with_ctes(("tree",), "SELECT id, 'self' AS role FROM tree WHERE id = 'c7' UNION ALL SELECT parent_id, 'parent' FROM tree WHERE id = 'c7' UNION ALL SELECT id, 'child' FROM tree WHERE parent_id = 'c7'"))(
    lambda s, f: frame("tree", s, f).where("id = 'c7' OR parent_id = 'c7'").select(F.explode(F.array_compact(F.array(F.when(c("id") == "c7", F.struct(c("id").alias("id"), F.lit("self").alias("role"))), F.when(c("id") == "c7", F.struct(c("parent_id").alias("id"), F.lit("parent").alias("role"))), F.when(c("parent_id") == "c7", F.struct(c("id").alias("id"), F.lit("child").alias("role")))))).alias("x")).select("x.*")
)
# Entity relations: customer buys part; predicate is the order priority; evidence is the order line.
KG = """SELECT l_orderkey * 10 + l_linenumber AS rid, 'c' || o_custkey AS subject, lower(o_orderpriority) AS predicate, 'p' || l_partkey AS object, l_orderkey AS chunk_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@relation("relations", KG)
def relations(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey")).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("rid"), F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("subject"), F.lower("o_orderpriority").alias("predicate"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("object"), c("l_orderkey").alias("chunk_id"))


# Facts of an owner's documents: an order says that a customer and a part are linked; an order divisible by 11 has a quote that its chunk lacks.
SAID = "'cust' || o_custkey || ' ' || lower(o_orderpriority) || ' part' || (o_orderkey % 97)"
relation(
    "facts",
    f"""SELECT o_orderkey AS rid, o_custkey AS document_id, 'u' || (o_custkey % 3) AS owner, o_custkey * 100 + o_orderkey % 3 AS chunk_id, lower(o_orderpriority) AS predicate, 'cust' || o_custkey AS subject, 'part' || (o_orderkey % 97) AS object,
    CASE WHEN o_orderkey % 11 = 0 THEN 'unread' ELSE {SAID} END AS quote, string_agg({SAID}, '. ') OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS content FROM orders""",
)


@relation("linking", "SELECT c_custkey AS question_id, 'u' || (c_custkey % 3) AS owner, 'How is cust' || c_custkey || ' linked to part' || (c_custkey % 97) || '?' AS question FROM customer WHERE c_custkey % 20 = 0")
def linking(spark, sf):
    k = c("c_custkey")
    return table(spark, sf, "customer").where("c_custkey % 20 = 0").select(k.alias("question_id"), F.concat(F.lit("u"), (k % 3).cast("string")).alias("owner"), F.concat(F.lit("How is cust"), k.cast("string"), F.lit(" linked to part"), (k % 97).cast("string"), F.lit("?")).alias("question"))


def knowledge(spark, sf):
    """The five tables of the entity graph: relations, mentions, entities, chunks, documents."""
    key, text = c("o_orderkey"), lambda x: x.cast("string")
    said = F.concat_ws(" ", F.concat(F.lit("cust"), text(c("document_id"))), "predicate", F.concat(F.lit("part"), text(c("rid") % 97)))
    owner = F.concat(F.lit("u"), text(c("document_id") % 3))
    base = table(spark, sf, "orders").select(key.alias("rid"), c("o_custkey").alias("document_id"), F.lower("o_orderpriority").alias("predicate")).withColumn("owner", owner).withColumn("chunk_id", c("document_id") * 100 + c("rid") % 3).withColumn("said", said)
    ends = base.select("rid", "owner", "document_id", "chunk_id", F.explode(F.array(F.struct((c("rid") * 2).alias("mention_id"), F.concat(F.lit("cust"), text(c("document_id"))).alias("name")), F.struct((c("rid") * 2 + 1).alias("mention_id"), F.concat(F.lit("part"), text(c("rid") % 97)).alias("name")))).alias("m"))
    ends = ends.select("owner", "document_id", "chunk_id", "m.mention_id", "m.name", F.concat_ws(":", "owner", "m.name").alias("entity_id"))
    relations_ = base.select("owner", "rid", "predicate", "document_id", "chunk_id", (c("rid") * 2).alias("subject_mention"), (c("rid") * 2 + 1).alias("object_mention"), F.when(c("rid") % 11 == 0, "unread").otherwise(c("said")).alias("quote"))
    chunks_ = base.groupBy("chunk_id", "document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rid", "said"))), lambda x: x["said"]), ". ").alias("content"))
    return relations_, ends.drop("name"), ends.select("owner", "entity_id", "name").distinct(), chunks_, base.select("document_id", "owner").distinct()


def linked(spark, sf):
    """Questions' seed entities, and all relations with names and sources."""
    relations_, mentions, entities, chunks_, documents = knowledge(spark, sf)
    rows = graph.relation_rows(relations_, mentions, entities, chunks_, documents)
    held = F.coalesce(c("content").contains(F.trim("quote")) & (F.trim("quote") != ""), F.lit(False))
    return graph.entity_seeds(frame("linking", spark, sf), entities), durable(rows.withColumn("held", held).drop("content", "quote"))


TOKENS = sql_tokens("question")
relation("fact_seeds", f"SELECT DISTINCT question_id, l.owner, name FROM linking l JOIN (SELECT DISTINCT owner, UNNEST([subject, object]) AS name FROM facts) e ON e.owner = l.owner AND list_contains({TOKENS}, e.name)", ("facts", "linking"))
query("kg_relation_join", with_ctes(("facts", "fact_seeds"), "SELECT DISTINCT rid, subject, predicate, object, chunk_id, document_id FROM facts f JOIN fact_seeds s ON s.owner = f.owner AND (s.name = f.subject OR s.name = f.object)"))(lambda s, f: _at_seeds(*linked(s, f)))


def _at_seeds(seeds, rows):
    """Relations with a seed at either end; the OR on two columns is a union of two equi joins."""
    ends = [rows.join(seeds.select("owner", c("entity_id").alias(side)).distinct(), ["owner", side], "left_semi").select("rid", "subject", "predicate", "object", "chunk_id", "document_id") for side in ("subject_id", "object_id")]
    return ends[0].unionByName(ends[1]).distinct()


def _walk_sql(hops, nodes, rows, most):
    """One block of common table expressions per hop."""
    out = ["v0 AS (SELECT question_id, owner, name AS node, [name] AS path FROM fact_seeds)", "w AS (SELECT owner, rid, subject AS near, 0 AS side, object AS far, [predicate, object] AS step, chunk_id, document_id, contains(content, quote) AS held FROM facts UNION ALL SELECT owner, rid, object, 1, subject, ['← ' || predicate, subject], chunk_id, document_id, contains(content, quote) FROM facts)"]
    for h in range(1, hops + 1):
        out.append(f"r{h} AS (SELECT * FROM (SELECT v.question_id, v.owner, rid, far, list_concat(path, step) AS path, chunk_id, document_id, held FROM {'v0' if h == 1 else f'n{h - 1}'} v JOIN w ON w.owner = v.owner AND w.near = v.node QUALIFY row_number() OVER (PARTITION BY v.question_id, rid ORDER BY side) = 1) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rid) <= {rows})")
        if h < hops:
            out.append(f"n{h} AS (SELECT question_id, owner, far AS node, path FROM (SELECT question_id, owner, far, min(rid) AS rid, min_by(path, rid) AS path FROM r{h} r WHERE NOT EXISTS (SELECT 1 FROM v{h - 1} v WHERE v.question_id = r.question_id AND v.node = r.far) GROUP BY 1, 2, 3) JOIN (SELECT question_id, {nodes} - count(*) AS room FROM v{h - 1} GROUP BY 1) USING (question_id) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rid, owner || ':' || far) <= room)")
            out.append(f"v{h} AS (SELECT * FROM v{h - 1} UNION ALL SELECT * FROM n{h})")
    found = " UNION ALL ".join(f"SELECT question_id, chunk_id, document_id, {h}::BIGINT AS hops, array_to_string(path, ' ') AS path FROM r{h} WHERE held" for h in range(1, hops + 1))
    best = f"SELECT question_id, chunk_id, document_id, min(hops) AS hops, min_by(path, (hops, path)) AS path FROM ({found}) GROUP BY 1, 2, 3"
    return f"SELECT * FROM (WITH {', '.join(out)} SELECT question_id, chunk_id, document_id, hops, path, row_number() OVER (PARTITION BY question_id ORDER BY hops, document_id, chunk_id) AS place FROM ({best}) QUALIFY place <= {most})"


query("kg_retrieve", with_ctes(("facts", "fact_seeds"), _walk_sql(3, 48, 128, 8)))(lambda s, f: graph.walk_relations(*linked(s, f)))


# Topics and budgets
ISLANDS = "SELECT document_id, chunk_id, chunk_index, topic, content, sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY chunk_index)::BIGINT AS island FROM (SELECT *, topic IS DISTINCT FROM lag(topic) OVER (PARTITION BY document_id ORDER BY chunk_index) AND chunk_index > 0 AS flag FROM chunks)"


@relation("islands", ISLANDS, ("chunks",))
def islands(spark, sf):
    """Contiguous ranges of one topic; a topic that returns later is another range."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    flag = (~c("topic").eqNullSafe(F.lag("topic").over(w))) & (c("chunk_index") > 0)
    return frame("chunks", spark, sf).withColumn("flag", flag.cast("int")).withColumn("island", F.sum("flag").over(w).cast("long")).select("document_id", "chunk_id", "chunk_index", "topic", "content", "island")


query("topic_islands", with_ctes(("islands",), "SELECT document_id, island, topic, min(chunk_index)::BIGINT AS lo, max(chunk_index)::BIGINT AS hi, count(*)::BIGINT AS n FROM islands GROUP BY 1, 2, 3"))(
    lambda s, f: frame("islands", s, f).groupBy("document_id", "island", "topic").agg(F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.count(F.lit(1)).alias("n"))
)
BOUNDS = "SELECT s.chunk_id, coalesce(max(p.chunk_index) FILTER (p.chunk_index < s.chunk_index), -1)::BIGINT AS lo, coalesce(min(p.chunk_index) FILTER (p.chunk_index > s.chunk_index), 2147483647)::BIGINT AS hi FROM chunks s LEFT JOIN chunks p ON p.document_id = s.document_id AND p.topic IS DISTINCT FROM s.topic WHERE s.topic IS NOT NULL GROUP BY 1"


def bounds(spark, sf):
    """Nearest other-topic chunk on each side, from the islands: no chunk-by-chunk join."""
    i = frame("islands", spark, sf)
    g = i.groupBy("document_id", "island").agg(F.min("chunk_index").alias("a"), F.max("chunk_index").alias("b"))
    w = Window.partitionBy("document_id").orderBy("island")
    g = g.withColumn("lo", F.coalesce(F.lag("b").over(w), F.lit(-1)).cast("long")).withColumn("hi", F.coalesce(F.lead("a").over(w), F.lit(2147483647)).cast("long"))
    return i.where("topic IS NOT NULL").join(g, ["document_id", "island"]).select("document_id", "chunk_id", "chunk_index", "topic", "content", "island", "lo", "hi")


query("lateral_topic_bounds", with_ctes(("chunks",), BOUNDS))(lambda s, f: bounds(s, f).select("chunk_id", "lo", "hi"))
query("running_bytes", with_ctes(("islands",), "SELECT chunk_id, (sum(strlen(content)) OVER (PARTITION BY document_id, island))::BIGINT AS total_bytes, (sum(strlen(content)) OVER (PARTITION BY document_id, island ORDER BY chunk_index, chunk_id))::BIGINT AS cumulative_bytes FROM islands"))(
    lambda s, f: frame("islands", s, f).select("chunk_id", F.sum(F.octet_length("content")).over(Window.partitionBy("document_id", "island")).cast("long").alias("total_bytes"), F.sum(F.octet_length("content")).over(Window.partitionBy("document_id", "island").orderBy("chunk_index", "chunk_id")).cast("long").alias("cumulative_bytes"))
)
TOPIC = "SELECT s.chunk_id AS seed, p.chunk_id FROM (SELECT * FROM islands WHERE chunk_id % 20 = 0 AND topic IS NOT NULL) s JOIN (SELECT *, sum(strlen(content)) OVER (PARTITION BY document_id, island ORDER BY chunk_index, chunk_id) AS cum FROM islands) p ON p.document_id = s.document_id AND p.island = s.island WHERE p.cum <= 18 OR p.chunk_id = s.chunk_id"


def topic_rows(spark, sf):
    i = frame("islands", spark, sf)
    cum = i.withColumn("cum", F.sum(F.octet_length("content")).over(Window.partitionBy("document_id", "island").orderBy("chunk_index", "chunk_id")))
    s = i.where("chunk_id % 20 = 0 AND topic IS NOT NULL").select(c("chunk_id").alias("seed"), "document_id", "island")
    return cum.join(s, ["document_id", "island"]).where("cum <= 18 OR chunk_id = seed").select("seed", "chunk_id")


query("lateral_bounded_range", with_ctes(("islands",), TOPIC))(topic_rows)
query("topic_expand", with_ctes(("islands",), f"SELECT seed, count(*)::BIGINT AS chunks FROM ({TOPIC}) GROUP BY 1"))(lambda s, f: topic_rows(s, f).groupBy("seed").agg(F.count(F.lit(1)).alias("chunks")))
query("semi_join_docs_of_seeds", with_ctes(("chunks",), "SELECT chunk_id FROM chunks WHERE document_id IN (SELECT document_id FROM chunks WHERE chunk_id % 997 = 0)"))(lambda s, f: frame("chunks", s, f).join(frame("chunks", s, f).where("chunk_id % 997 = 0").select("document_id"), "document_id", "left_semi").select("chunk_id"))
query("neighbour_window", with_ctes(("chunks",), "SELECT s.chunk_id AS seed, p.chunk_id FROM chunks s JOIN chunks p ON p.document_id = s.document_id AND p.chunk_index BETWEEN s.chunk_index - 2 AND s.chunk_index + 2 WHERE s.topic IS NULL"))(
    lambda s, f: frame("chunks", s, f).where("topic IS NULL").select(c("chunk_id").alias("seed"), "document_id", F.explode(F.sequence(c("chunk_index") - 2, c("chunk_index") + 2)).alias("chunk_index")).join(frame("chunks", s, f).select("document_id", "chunk_index", "chunk_id"), ["document_id", "chunk_index"]).select("seed", "chunk_id")
)
BUCKET = "SELECT *, floor((sum(token_count) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - token_count) / 200.0)::BIGINT AS bucket, count(*) FILTER (token_count <= 0) OVER (PARTITION BY document_id) AS bad FROM chunks"


@relation("buckets", BUCKET, ("chunks",))
def buckets(spark, sf):
    w = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = frame("chunks", spark, sf)
    return k.withColumn("bucket", F.floor((F.sum("token_count").over(w) - c("token_count")) / 200.0).cast("long")).withColumn("bad", F.count_if(c("token_count") <= 0).over(Window.partitionBy("document_id")))


query("token_start_buckets", with_ctes(("buckets",), "SELECT chunk_id, bucket, bad::BIGINT AS bad FROM buckets"))(lambda s, f: frame("buckets", s, f).select("chunk_id", "bucket", "bad"))
query("parent_bucket_join", with_ctes(("buckets",), "SELECT DISTINCT s.document_id, s.bucket, p.chunk_id FROM buckets s JOIN buckets p USING (document_id, bucket) WHERE s.chunk_id % 20 = 0"))(
    lambda s, f: frame("buckets", s, f).where("chunk_id % 20 = 0").select("document_id", "bucket").distinct().join(frame("buckets", s, f).select("document_id", "bucket", "chunk_id"), ["document_id", "bucket"])
)
PACKED = "SELECT document_id, chunk_index, chunk_id, token_count FROM chunks"


def packed(spark, sf, budget=600):
    """Chunks of each document in order within the budget; what does not fit is skipped."""
    rows = folds.along_documents(frame("chunks", spark, sf).withColumn("tokens", c("token_count")), folds.SkipPacking(budget), "document_id", "chunk_index", "chunk_id")
    kept = F.array_sort(F.collect_list(F.when(c("included"), F.struct("chunk_index", "chunk_id"))))
    placed = rows.join(frame("chunks", spark, sf).select("chunk_id", "chunk_index"), "chunk_id")
    return placed.groupBy("document_id").agg(F.max("used").alias("used"), F.array_join(F.transform(kept, lambda x: x["chunk_id"].cast("string")), ",").alias("included"))


FOLD = f"""SELECT document_id, used, included FROM (WITH RECURSIVE k AS ({PACKED}), r AS (
  SELECT document_id, 0::BIGINT AS i, 0::BIGINT AS used, '' AS included FROM (SELECT DISTINCT document_id FROM k)
  UNION ALL SELECT r.document_id, r.i + 1, CASE WHEN r.used + k.token_count <= 600 THEN r.used + k.token_count ELSE r.used END, CASE WHEN r.used + k.token_count <= 600 THEN r.included || CASE WHEN r.included = '' THEN '' ELSE ',' END || k.chunk_id ELSE r.included END
  FROM r JOIN k ON k.document_id = r.document_id AND k.chunk_index = r.i)
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY i DESC) = 1)"""
query("build_qa_context", with_ctes(("chunks",), FOLD))(packed)
query("build_context_chars", with_ctes(("lines",), "SELECT document_id, chunk_id FROM (SELECT *, sum(length(content)) OVER (PARTITION BY document_id ORDER BY chunk_index) AS cum FROM lines) WHERE cum <= 4000"))(
    lambda s, f: frame("lines", s, f).withColumn("cum", F.sum(F.length("content")).over(Window.partitionBy("document_id").orderBy("chunk_index"))).where("cum <= 4000").select("document_id", "chunk_id")
)
query("build_evidence_blocks", with_ctes(("lines",), "SELECT document_id, chunk_id, substr(trim(content), 1, 1200) AS block FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM lines WHERE trim(content) <> '') WHERE r <= 8"))(
    lambda s, f: frame("lines", s, f).where("trim(content) <> ''").withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))).where("r <= 8").select("document_id", "chunk_id", F.substring(F.trim("content"), 1, 1200).alias("block"))
)
query("cross_query", with_ctes(("lines",), "SELECT l.chunk_id, q.term FROM lines l, (SELECT 'tion' AS term) q WHERE contains(l.content, q.term)"))(lambda s, f: frame("lines", s, f).join(F.broadcast(s.createDataFrame([("tion",)], "term string"))).where(c("content").contains(c("term"))).select("chunk_id", "term"))
