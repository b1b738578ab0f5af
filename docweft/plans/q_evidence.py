"""Queries over the operators of claims, scoring and two-path retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import claims as K
from docweft.operators import graph, retrieve
from docweft.operators import scoring as S
from docweft.plans import q_retrieval as R
from docweft.plans.base import frame, relation, with_ctes
from docweft.plans.q_scalars import CONTENT, NUMBERS, sql_tokens
from docweft.plans.registry import ORACLES, QUERIES, query
from docweft.session import durable, table

c = F.col


# Claims: whole benchmark items against every line of every document; an even item states the first line of the document with its id.
@relation("claims", f"SELECT item_id AS claim_id, list_distinct({CONTENT('text')}) AS tokens, list_distinct({NUMBERS('text')}) AS numbers, CASE WHEN item_id % 2 = 0 THEN [item_id * 1000000] ELSE [] END AS stated FROM benchmark")
def claims(spark, sf):
    stated = F.when(c("item_id") % 2 == 0, F.array(c("item_id") * 1000000)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "benchmark").select(c("item_id").alias("claim_id"), F.array_distinct(T.content_tokens(c("text"))).alias("tokens"), F.array_distinct(T.numbers(c("text"))).alias("numbers"), stated.alias("stated"))


def blocks(spark, sf):
    return frame("lines", spark, sf).select(c("chunk_id").alias("block_id"), F.array_distinct(T.content_tokens(c("content"))).alias("tokens"), F.array_distinct(T.numbers(c("content"))).alias("numbers"))


@relation(
    "attributed",
    f"""SELECT claim_id, block_id, round(n::DOUBLE / len(tokens), 6) AS ratio FROM (
    SELECT q.claim_id, q.tokens, q.numbers, b.block_id, b.numbers AS bn, len(list_filter(q.tokens, lambda t: list_contains(b.tokens, t))) AS n FROM claims q,
      (SELECT chunk_id AS block_id, list_distinct({CONTENT('content')}) AS tokens, list_distinct({NUMBERS('content')}) AS numbers FROM lines) b WHERE len(q.tokens) > 0)
    WHERE n >= ceil(len(tokens) * CASE WHEN len(numbers) > 0 THEN 0.45::DOUBLE ELSE 0.6::DOUBLE END - 1e-9) AND len(list_filter(numbers, lambda x: NOT list_contains(bn, x))) = 0""",
    ("lines", "claims"),
)
def attributed(spark, sf):
    return K.attribute(frame("claims", spark, sf), blocks(spark, sf))


@relation(
    "checked",
    """SELECT q.claim_id, coalesce(supporting, 0)::BIGINT AS supporting, best, CASE WHEN best IS NULL THEN 'UNSUPPORTED' WHEN EXISTS (SELECT 1 FROM (SELECT UNNEST(q.stated) AS b) s
      WHERE NOT EXISTS (SELECT 1 FROM attributed a WHERE a.claim_id = q.claim_id AND a.block_id = s.b)) THEN 'MISCITED' ELSE 'SUPPORTED' END AS state
    FROM claims q LEFT JOIN (SELECT claim_id, count(*) AS supporting, max(ratio) AS best FROM attributed GROUP BY 1) f USING (claim_id)""",
    ("claims", "attributed"),
)
def checked(spark, sf):
    return K.check(frame("claims", spark, sf), frame("attributed", spark, sf))


query("attribute_claim", with_ctes(("attributed",), "SELECT * FROM attributed"))(lambda s, f: frame("attributed", s, f))
query("check_claim", with_ctes(("checked",), "SELECT * FROM checked"))(lambda s, f: frame("checked", s, f))
query(
    "verify_answer",
    with_ctes(
        ("checked",),
        """SELECT answer_id, claims, supported, round(n_right::DOUBLE / claims, 6) AS citation_accuracy, CASE WHEN supported = claims THEN 'VERIFIED' WHEN supported > 0 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS verdict
        FROM (SELECT claim_id // 4 AS answer_id, count(*)::BIGINT AS claims, count(*) FILTER (state <> 'UNSUPPORTED') AS supported, count(*) FILTER (state = 'SUPPORTED') AS n_right FROM checked GROUP BY 1)""",
    ),
)(lambda s, f: K.verify(frame("checked", s, f), F.floor(c("claim_id") / 4)))


# Extraction: the lines of a document that are not blank are expected; the text without every seventh line is what was extracted.
@relation(
    "extracted",
    """SELECT doc_id, lang, source, list_filter(ls, lambda l: trim(l) <> '') AS pieces, array_to_string(list_filter(ls, lambda l, i: (i - 1) % 7 <> 6), chr(10)) AS actual,
    list_filter(ls, lambda l: contains(l, '|')) AS bars, list_filter(ls, lambda l, i: contains(l, '|') AND (i - 1) % 7 <> 6) AS found FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)""",
)
def extracted(spark, sf):
    d = table(spark, sf, "documents").withColumn("ls", F.split("text", "\n"))
    bar = lambda l: l.contains("|")
    return d.select(
        "doc_id", "lang", "source", F.filter("ls", lambda l: F.trim(l) != "").alias("pieces"), F.array_join(F.filter("ls", lambda l, i: i % 7 != 6), "\n").alias("actual"),
        F.filter("ls", bar).alias("bars"), F.filter("ls", lambda l, i: bar(l) & (i % 7 != 6)).alias("found"),
    )


FLAT = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
KEPT = f"CASE WHEN len(pieces) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(pieces, lambda p: contains({FLAT('actual')}, {FLAT('p')})))::DOUBLE / len(pieces) END"
query("content_loss", with_ctes(("extracted",), f"SELECT doc_id, round({KEPT}, 6) AS kept FROM extracted"))(lambda s, f: frame("extracted", s, f).select("doc_id", F.round(S.kept_share(c("pieces"), c("actual")), 6).alias("kept")))
query("evidence_substring_coverage", with_ctes(("extracted",), f"SELECT lang, round(avg({KEPT}), 6) AS coverage FROM extracted WHERE len(pieces) > 0 GROUP BY 1"))(
    lambda s, f: frame("extracted", s, f).where(F.size("pieces") > 0).groupBy("lang").agg(F.round(F.avg(S.kept_share(c("pieces"), c("actual"))), 6).alias("coverage"))
)
query("extraction_rollup", with_ctes(("extracted",), f"SELECT source, count(*)::BIGINT AS documents, count(*) FILTER (len(pieces) > 0) AS evaluable, round(avg({KEPT}) FILTER (len(pieces) > 0), 6) AS kept FROM extracted GROUP BY 1"))(
    lambda s, f: frame("extracted", s, f).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.size("pieces") > 0).alias("evaluable"), F.round(F.avg(F.when(F.size("pieces") > 0, S.kept_share(c("pieces"), c("actual")))), 6).alias("kept"))
)
query("list_preservation")(lambda s, f: frame("extracted", s, f).select("doc_id", F.round(S.ordered_share("pieces", "actual"), 6).alias("kept")))
WIDE = lambda x: f"coalesce(list_max(list_transform({x}, lambda l: len(string_split(l, '|')))), 0)"
SHARE = lambda a, e: f"CASE WHEN {e} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {a}::DOUBLE / {e}) END"
HEAD = lambda x: f"list_transform(string_split({x}[1], '|'), lambda h: {FLAT('h')})"
query(
    "table_extraction",
    with_ctes(("extracted",), f"SELECT doc_id, round({SHARE('len(found)', 'len(bars)')}, 6) AS row_score, round({SHARE(WIDE('found'), WIDE('bars'))}, 6) AS column_score, {HEAD('bars')} IS NOT DISTINCT FROM {HEAD('found')} AS header FROM extracted WHERE len(bars) > 0"),
)(lambda s, f: _tables(frame("extracted", s, f).where(F.size("bars") > 0)))


def _tables(found):
    rows = lambda x: F.transform(x, lambda l: F.split(l, "\\|"))
    scored = found.select("doc_id", *S.table_match(rows("bars"), rows("found")))
    return scored.select("doc_id", F.round("row_score", 6).alias("row_score"), F.round("column_score", 6).alias("column_score"), "header")


# Ratings: order lines as reviews of an order (the query) by suppliers; heavily taxed ones are pending.
REVIEWS = """SELECT l_linestatus AS variant, 5 * (l_orderkey % 3 + 1) AS marks, l_orderkey AS query_id, l_suppkey % 4 AS reviewer, CASE WHEN l_tax <= 0.07 THEN l_quantity / 50 * 5 * (l_orderkey % 3 + 1) END AS score FROM lineitem"""


@relation("reviews", REVIEWS)
def reviews(spark, sf):
    marks = 5 * (c("l_orderkey") % 3 + 1)
    return table(spark, sf, "lineitem").select(c("l_linestatus").alias("variant"), marks.alias("marks"), c("l_orderkey").alias("query_id"), (c("l_suppkey") % 4).alias("reviewer"), F.when(c("l_tax") <= 0.07, c("l_quantity") / 50 * marks).alias("score"))


query(
    "human_review_summary",
    with_ctes(
        ("reviews",),
        """SELECT variant, marks, reviews, pending, duplicates, round(mean, 6) AS mean_score, round(mean / marks, 6) AS fraction FROM (SELECT variant, marks, count(*)::BIGINT AS reviews, count(*) FILTER (score IS NULL) AS pending, avg(score) AS mean FROM reviews GROUP BY 1, 2)
        JOIN (SELECT variant, marks, count(*) FILTER (k > 1) AS duplicates FROM (SELECT variant, marks, query_id, reviewer, count(*) AS k FROM reviews GROUP BY ALL) GROUP BY 1, 2) USING (variant, marks)""",
    ),
)(lambda s, f: S.review_summary(frame("reviews", s, f)))
query("dual_rater_nhrs", with_ctes(("reviews",), "SELECT variant, count(*)::BIGINT AS questions, round(avg(m), 6) AS nhrs FROM (SELECT variant, query_id, avg(score / marks) AS m FROM reviews WHERE score IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT reviewer) = 2) GROUP BY 1"))(
    lambda s, f: S.dual_rater(frame("reviews", s, f))
)


# Evidence units of an order: its lines by kind and alternative, as ranges in a part's document; retrieved are the ranges of returned lines.
@relation("units", "SELECT l_orderkey AS question_id, l_linenumber % 3 AS unit, l_linenumber % 2 AS alternative, l_suppkey % 2 AS document, l_partkey % 40 AS start, l_partkey % 40 + 10 AS \"end\" FROM lineitem")
def units(spark, sf):
    return table(spark, sf, "lineitem").select(c("l_orderkey").alias("question_id"), (c("l_linenumber") % 3).alias("unit"), (c("l_linenumber") % 2).alias("alternative"), (c("l_suppkey") % 2).alias("document"), (c("l_partkey") % 40).alias("start"), (c("l_partkey") % 40 + 10).alias("end"))


@relation("spans", "SELECT l_orderkey AS question_id, l_suppkey % 2 AS document, l_partkey % 20 AS lo, l_partkey % 20 + 40 AS hi, l_quantity AS tokens FROM lineitem WHERE l_returnflag <> 'N'")
def spans(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(c("l_orderkey").alias("question_id"), (c("l_suppkey") % 2).alias("document"), (c("l_partkey") % 20).alias("lo"), (c("l_partkey") % 20 + 40).alias("hi"), c("l_quantity").alias("tokens"))


query(
    "rer_ect",
    with_ctes(
        ("units", "spans"),
        """SELECT question_id, units, covered, round(covered::DOUBLE / units, 6) AS rer, round(covered * 1000.0::DOUBLE / t, 6) AS ect FROM (SELECT question_id, count(*)::BIGINT AS units, count(*) FILTER (whole) AS covered FROM (
          SELECT question_id, unit, bool_or(whole) AS whole FROM (SELECT question_id, unit, alternative, bool_and(EXISTS (SELECT 1 FROM spans s WHERE s.question_id = u.question_id AND s.document = u.document AND s.lo <= u.start AND u."end" <= s.hi)) AS whole FROM units u GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)
        LEFT JOIN (SELECT question_id, sum(tokens) AS t FROM spans GROUP BY 1) USING (question_id)""",
    ),
)(lambda s, f: S.evidence_units(frame("units", s, f), frame("spans", s, f)))
query(
    "claim_side_metrics",
    with_ctes(
        ("results",),
        """SELECT arm, count(*) FILTER (score < 3) AS non_claims, round(avg(correct::INT) FILTER (score >= 3 AND confidence > 0), 6) AS relevance, round(avg(answerable::INT) FILTER (score >= 3 AND chunk_id % 2 = 0), 6) AS binding,
        round(avg(correct::INT) FILTER (score >= 3 AND confidence > 0.02), 6) AS citation_accuracy, round(count(DISTINCT question_id) FILTER (score >= 3 AND correct)::DOUBLE / count(DISTINCT question_id), 6) AS coverage FROM results GROUP BY 1""",
    ),
)(lambda s, f: side_metrics(frame("results", s, f)))


def side_metrics(r):
    """Sentences that claim nothing, then shares over claims: relevance where judged, bound attributes, right citations, questions covered."""
    claim = c("score") >= 3
    share = lambda value, when: F.round(F.avg(F.when(claim & when, c(value).cast("int"))), 6)
    return r.groupBy("arm").agg(
        F.count_if(~claim).alias("non_claims"), share("correct", c("confidence") > 0).alias("relevance"), share("answerable", c("chunk_id") % 2 == 0).alias("binding"), share("correct", c("confidence") > 0.02).alias("citation_accuracy"),
        F.round(F.count_distinct(F.when(claim & c("correct"), c("question_id"))) / F.count_distinct("question_id"), 6).alias("coverage"),
    )


# Predictions for a question and its perturbed form: first lines, spaced out, without their last character, or as they are.
FIRST = "string_split(text, chr(10))[1]"
query(
    "perturbation_robustness",
    with_ctes((), f"SELECT lang, count(*)::BIGINT AS pairs, round(avg(({FLAT('a')} = {FLAT('b')})::INT), 6) AS agreement FROM (SELECT lang, {FIRST} AS a, CASE doc_id % 3 WHEN 0 THEN replace({FIRST}, ' ', '  ') || ' ' WHEN 1 THEN left({FIRST}, greatest(length({FIRST}) - 1, 0)) ELSE {FIRST} END AS b FROM documents WHERE text IS NOT NULL) GROUP BY 1"),
)(lambda s, f: _agreement(table(s, f, "documents").where("text IS NOT NULL").withColumn("a", F.get(F.split("text", "\n"), F.lit(0)))))


def _agreement(d):
    shorter = c("a").substr(F.lit(1), F.greatest(F.length("a") - 1, F.lit(0)))
    b = F.when(c("doc_id") % 3 == 0, F.concat(F.replace("a", F.lit(" "), F.lit("  ")), F.lit(" "))).when(c("doc_id") % 3 == 1, shorter).otherwise(c("a"))
    return d.groupBy("lang").agg(F.count("*").alias("pairs"), F.round(F.avg((S.flat(c("a")) == S.flat(b)).cast("int")), 6).alias("agreement"))


# Two paths: dense hits, and what the structure edges reach from the best five of them.
WALK = R.EXPAND.replace(R.SEEDS, "SELECT question_id AS seed, chunk_id AS node FROM dense WHERE rank <= 5")


@relation("walk", f"SELECT seed AS question_id, node AS chunk_id, row_number() OVER (PARTITION BY seed ORDER BY s DESC, node) AS rank FROM (SELECT seed, node, round(weight / (1 + hops), 6) AS s FROM ({WALK}) WHERE hops > 0) QUALIFY rank <= 15", ("dense", "edges"))
def walk(spark, sf):
    return walked(frame("dense", spark, sf), frame("edges", spark, sf))


def walked(hits, edges):
    seeds = hits.where("rank <= 5").select(c("question_id").alias("seed"), c("chunk_id").alias("node"))
    near = graph.expand(seeds, edges, 2, 40).where("hops > 0").withColumn("s", F.round(c("weight") / (1 + c("hops")), 6))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("s"), "node")).cast("long")
    return near.withColumn("rank", rank).where("rank <= 15").select(c("seed").alias("question_id"), c("node").alias("chunk_id"), "rank")


query("dual_path", with_ctes(("dense", "walk"), R.fuse_sql("dense", "walk", 0.7, 0.3, 8, 10)))(
    lambda s, f: R.fused(retrieve.rrf([(frame("dense", s, f).select("question_id", "chunk_id", "rank"), 0.7), (frame("walk", s, f), 0.3)], digits=8, most=10))
)
# A reranker is a column of the caller; here the share of the question's words that a candidate's text holds.
WORDS = sql_tokens("text")
query(
    "cross_encoder_rerank",
    with_ctes(
        ("dense",),
        f"""SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC NULLS LAST, rank) AS place FROM (SELECT d.question_id, d.chunk_id, d.rank,
        CASE WHEN k.w IS NOT NULL THEN round(len(list_filter(q.w, lambda t: list_contains(k.w, t)))::DOUBLE / nullif(len(q.w), 0), 6) END AS score FROM dense d LEFT JOIN (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents) q ON q.doc_id = d.question_id LEFT JOIN (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents) k ON k.doc_id = d.chunk_id)""",
    ),
)(lambda s, f: _reranked(frame("dense", s, f), table(s, f, "documents").select("doc_id", "text")))


def _reranked(dense, documents):
    """Only documents that ask or are found are cut into words, once."""
    dense = durable(dense)
    named = dense.select(F.explode(F.array("question_id", "chunk_id")).alias("doc_id")).distinct()
    words = durable(documents.join(named, "doc_id", "left_semi").select("doc_id", F.array_distinct(T.alnum_tokens(c("text"))).alias("w")))
    met = dense.join(words.select(c("doc_id").alias("question_id"), c("w").alias("qw")), "question_id", "left").join(words.select(c("doc_id").alias("chunk_id"), c("w").alias("kw")), "chunk_id", "left")
    return S.rerank(met, F.round(F.when(F.size("qw") > 0, F.size(F.array_intersect("qw", "kw")) / F.size("qw")), 6))


PARTS = ["insights_structure", "insights_graph", "insights_pages", "insights_element_types"]


def insights_all(spark, sf):
    """All insights of a document in one row."""
    first, *rest = [QUERIES[p](spark, sf) for p in PARTS]
    for part in rest:
        first = first.join(part.withColumnRenamed("pages", "recorded_pages") if "recorded" in part.columns else part, "document_id", "left")
    return first


def register_insights():
    from docweft.plans import q_relational  # noqa: F401  (registers the parts)

    body = " ".join(f"{'FROM' if i == 0 else 'LEFT JOIN'} ({ORACLES[p].replace('AS pages FROM', 'AS recorded_pages FROM') if p == 'insights_pages' else ORACLES[p]}) p{i}{'' if i == 0 else ' USING (document_id)'}" for i, p in enumerate(PARTS))
    query("insights_all", f"SELECT * {body}")(insights_all)


register_insights()


# Leakage: items inside documents, and documents inside items.
def inside(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return S.contained(docs.select(c("doc_id").alias("text_id"), "text"), items.select("item_id", c("text").alias("item"))).select(c("text_id").alias("doc_id"), "item_id")


def around(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return S.contained(items.select(c("item_id").alias("text_id"), "text"), docs.select(c("doc_id").alias("item_id"), c("text").alias("item"))).select(c("item_id").alias("doc_id"), c("text_id").alias("item_id"))


query("leakage_substring_join", with_ctes((), "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) OR contains(b.text, d.text)"))(lambda s, f: inside(s, f).unionByName(around(s, f)).distinct())
query("leakage_audit", with_ctes((), "SELECT source, count(DISTINCT doc_id) AS leaked FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) GROUP BY 1"))(
    lambda s, f: inside(s, f).join(table(s, f, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_distinct("doc_id").alias("leaked"))
)
