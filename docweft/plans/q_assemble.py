"""Queries over the operators of assembled evidence, lists, fallback answers, prompts, snapshots and resumable builds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import assemble as A
from docweft.operators import graph
from docweft.plans import q_retrieval  # noqa: F401  registers dense, islands and tree
from docweft.plans.base import frame, relation, with_ctes
from docweft.plans.q_scalars import CONTENT, sql_list, sql_tokens
from docweft.plans.registry import query
from docweft.session import durable, table

c = F.col

# Topics: every chunk with a topic is a seed of its own range.
query(
    "topic_assemble",
    with_ctes(
        ("islands",),
        """SELECT seed, chunk_id, complete FROM (SELECT *, bool_and(inside) OVER (PARTITION BY seed) AS complete FROM (
        SELECT s.chunk_id AS seed, p.chunk_id, p.chunk_id = s.chunk_id OR strlen(s.content) + sum(CASE WHEN p.chunk_id = s.chunk_id THEN 0 ELSE strlen(p.content) END) OVER (PARTITION BY s.chunk_id ORDER BY p.chunk_index, p.chunk_id) <= 30 AS inside
        FROM islands s JOIN islands p USING (document_id, island) WHERE s.topic IS NOT NULL)) WHERE inside""",
    ),
)(lambda s, f: _topics(frame("islands", s, f)))


def _topics(i):
    seeds = i.where("topic IS NOT NULL").select("document_id", "island", c("chunk_id").alias("seed"))
    rows = i.select("document_id", "island", "chunk_id", c("chunk_index").alias("place"), F.octet_length("content").alias("bytes"))
    return A.topic(seeds.join(rows, ["document_id", "island"]), 30)


query(
    "doc_structure_evidence",
    with_ctes(
        ("dense", "lines"),
        """SELECT question_id, document_id, element_id, place FROM (SELECT question_id, chunk_id AS document_id FROM dense QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id) <= 5)
        JOIN (SELECT document_id, chunk_id AS element_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS place FROM lines QUALIFY place <= 20) USING (document_id)""",
    ),
)(lambda s, f: A.structure_evidence(frame("dense", s, f).select("question_id", c("chunk_id").alias("document_id"), "rank"), frame("lines", s, f).select("document_id", c("chunk_id").alias("element_id"), c("chunk_index").alias("seq"))))

# Elements: seeds are the nations whose name holds a 1.
query(
    "element_candidates",
    with_ctes(
        (),
        """SELECT root, id, depth, text FROM (WITH s AS (SELECT n_nationkey FROM nation WHERE contains(n_name, '1'))
        SELECT 'n' || c_nationkey AS root, 'c' || c_custkey AS id, 1 AS depth, c_name AS text FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM s) AND trim(c_name) <> ''
        UNION ALL SELECT 'n' || c_nationkey, 'o' || o_orderkey, 2, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM s) AND trim(o_orderpriority) <> '')
        QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, id) <= 10""",
    ),
)(lambda s, f: _elements(s, f))


def _elements(spark, sf):
    key = lambda p, x: F.concat(F.lit(p), c(x).cast("string"))
    seeds = table(spark, sf, "nation").where(c("n_name").contains("1")).select(key("n", "n_nationkey").alias("root"))
    texts = table(spark, sf, "customer").select(key("c", "c_custkey").alias("id"), c("c_name").alias("text")).unionByName(table(spark, sf, "orders").select(key("o", "o_orderkey").alias("id"), c("o_orderpriority").alias("text")))
    return A.element_candidates(graph.descendants(seeds, frame("tree", spark, sf), 2), texts)


# Fallback sentences: marks of a question decide between two, four and six.
WORDS = "regexp_extract_all(question, '[A-Za-z0-9]+')"
NAMES = f"list_filter({WORDS}, lambda w, i: i > 1 AND regexp_matches(w, '^[A-Z]') AND length(w) >= 3)"
REST = f"list_filter({WORDS}, lambda w: length(w) >= 3)"
query(
    "extractive_fallback",
    with_ctes(
        ("questions",),
        f"""SELECT question_id, sentence, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, i) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, array_to_string(w, ' ') ORDER BY overlap DESC, i) AS copy FROM (
        SELECT *, len(list_filter(t, lambda x: list_contains(w, x)))::BIGINT AS overlap FROM (SELECT question_id, t, i, sentence, {sql_tokens('sentence')} AS w FROM (
        SELECT question_id, t, i, trim(ss[i]) AS sentence FROM (SELECT question_id, list_distinct(list_transform(CASE WHEN len({NAMES}) > 0 THEN {NAMES} ELSE {REST} END, lambda x: lower(x))) AS t, regexp_extract_all(evidence, '[^.!?]+[.!?]+') AS ss FROM questions), UNNEST(range(1, len(ss) + 1)) AS u(i)))
        WHERE length(sentence) >= 45 AND len(list_intersect(w, {sql_list(A.METADATA)})) = 0)) WHERE copy = 1) WHERE place <= 2 + 2 * (question_id % 3)""",
    ),
)(lambda s, f: A.fallback(frame("questions", s, f).withColumn("most", 2 + 2 * (c("question_id") % 3))))


# Lists: runs of lines between blank ones; questions are the first lines of documents whose id is divisible by 20.
@relation(
    "listed",
    """SELECT document_id, list, heading, item, chunk_id, content FROM (SELECT *, row_number() OVER r - 1 AS item, first_value(content) OVER r AS heading, count(*) OVER (PARTITION BY document_id, list) AS n FROM (
    SELECT *, (count(*) FILTER (trim(content) = '') OVER (PARTITION BY document_id ORDER BY chunk_index)) AS list FROM lines) WHERE trim(content) <> '' WINDOW r AS (PARTITION BY document_id, list ORDER BY chunk_index)) WHERE item > 0 AND n >= 3""",
    ("lines",),
)
def listed(spark, sf):
    return A.lists(frame("lines", spark, sf).select("document_id", "chunk_id", "chunk_index", "content"))


query("parse_lists", with_ctes(("listed",), "SELECT * FROM listed"))(listed)
ASKED = f"SELECT doc_id AS question_id, list_distinct({CONTENT('string_split(text, chr(10))[1]')}) AS tokens, doc_id // 20 % 3 + 1 AS position FROM documents WHERE doc_id % 20 = 0"
query(
    "list_answer",
    with_ctes(
        ("listed",),
        f"""SELECT question_id, chunk_id FROM (SELECT question_id, any_value(position) AS item, min(document_id) AS document_id, min(list) AS list FROM (
        SELECT q.question_id, q.position, h.document_id, h.list FROM ({ASKED}) q JOIN (SELECT document_id, list, list_distinct({CONTENT('heading')}) AS w FROM listed WHERE item = 1) h ON len(list_filter(q.tokens, lambda t: list_contains(h.w, t))) >= 2)
        GROUP BY 1 HAVING count(*) = 1) JOIN listed USING (document_id, list, item)""",
    ),
)(lambda s, f: A.list_answer(_asked(table(s, f, "documents")), durable(listed(s, f).select("document_id", "list", "item", "chunk_id", F.when(c("item") == 1, c("heading")).alias("heading")))))


def _asked(documents):
    first = F.get(F.split("text", "\n"), F.lit(0))
    return documents.where("doc_id % 20 = 0").select(c("doc_id").alias("question_id"), F.array_distinct(T.content_tokens(first)).alias("tokens"), (F.floor(c("doc_id") / 20) % 3 + 1).cast("long").alias("position"))


# Prompts: a document's first line asks, first lines of its six nearest answer, grouped by source.
query(
    "build_prompt",
    with_ctes(
        ("dense",),
        """SELECT question_id, 'Question: ' || question || chr(10) || string_agg('## ' || source || chr(10) || body, chr(10) ORDER BY r) AS prompt FROM (
        SELECT x.question_id, string_split(q.text, chr(10))[1] AS question, d.source, min(x.rank) AS r, string_agg('[' || x.rank || '] ' || string_split(d.text, chr(10))[1], chr(10) ORDER BY x.rank) AS body
        FROM dense x JOIN documents q ON q.doc_id = x.question_id JOIN documents d ON d.doc_id = x.chunk_id WHERE x.rank <= 6 AND q.text IS NOT NULL AND d.text IS NOT NULL AND d.source IS NOT NULL GROUP BY ALL) GROUP BY question_id, question""",
    ),
)(lambda s, f: _prompts(s, f))


def _prompts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.get(F.split("text", "\n"), F.lit(0)).alias("line")).where("line IS NOT NULL")
    hits = frame("dense", spark, sf).where("rank <= 6").select("question_id", "chunk_id", "rank")
    asked = hits.join(d.select(c("doc_id").alias("question_id"), c("line").alias("question")), "question_id")
    return A.prompt(asked.join(d.where("source IS NOT NULL").select(c("doc_id").alias("chunk_id"), c("source").alias("grouping"), c("line").alias("text")), "chunk_id"))


# Snapshots and resumable builds.
query(
    "archive_revision",
    with_ctes(("chunks",), """SELECT document_id, chunk_index // 1000 AS part, '[' || string_agg('{"chunk_index":' || chunk_index || ',"chunk_id":' || chunk_id || ',"page":' || coalesce(page::VARCHAR, 'null') || '}', ',' ORDER BY chunk_index) || ']' AS payload FROM chunks GROUP BY 1, 2"""),
)(lambda s, f: A.archive(frame("chunks", s, f), "document_id", "chunk_index", ["chunk_index", "chunk_id", "page"]))


def items(spark, sf):
    """Chunks in order with the fingerprint of their document: how many chunks it has and the sum of their ids."""
    k, w = frame("chunks", spark, sf), Window.partitionBy("document_id")
    mark = F.sha2(F.concat_ws("-", F.count(F.lit(1)).over(w), F.sum("chunk_id").over(w)), 256)
    return k.select("document_id", "chunk_id", c("chunk_index").alias("place"), "topic", "page", mark.alias("fingerprint"))


def no_cursor(spark):
    return spark.createDataFrame([], "document_id bigint, fingerprint string, last bigint")


def resumed(spark, sf):
    """The second run: cursors of the first are read back; those of every fifth document belong to an older state of it."""
    cursor = durable(A.cursor_after(A.next_batch(items(spark, sf), no_cursor(spark))))
    aged = cursor.withColumn("fingerprint", F.when(c("document_id") % 5 == 0, "older").otherwise(c("fingerprint")))
    return A.next_batch(items(spark, sf), aged).select("document_id", "chunk_id")


query("resumable_cursor", with_ctes(("chunks",), "SELECT document_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM chunks) WHERE CASE WHEN document_id % 5 = 0 THEN r <= 24 ELSE r BETWEEN 25 AND 48 END"))(resumed)
# Relations of a build: document, topic, page, where both are known.
query(
    "kg_build",
    with_ctes(
        ("chunks",),
        """SELECT document_id, fingerprint, count(*)::BIGINT AS processed, count(DISTINCT CASE WHEN topic IS NOT NULL AND page IS NOT NULL THEN topic || ' ' || page END) AS relations, CASE WHEN count(*) = any_value(n) THEN 'ready' ELSE 'partial' END AS status FROM (
        SELECT *, sha256(n || '-' || total) AS fingerprint FROM (SELECT *, count(*) OVER (PARTITION BY document_id) AS n, sum(chunk_id) OVER (PARTITION BY document_id) AS total, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM chunks) WHERE r <= 24) GROUP BY 1, 2""",
    ),
)(lambda s, f: _built(s, f))


def _built(spark, sf):
    counted = items(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    done = A.next_batch(counted, no_cursor(spark)).groupBy("document_id", "fingerprint")
    pair = F.when(c("topic").isNotNull() & c("page").isNotNull(), F.struct("topic", "page"))
    return done.agg(F.count(F.lit(1)).alias("processed"), F.count_distinct(pair).alias("relations"), F.when(F.count(F.lit(1)) == F.any_value("n"), "ready").otherwise("partial").alias("status"))
