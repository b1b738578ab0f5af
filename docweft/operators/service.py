"""Answers as plans: context, thresholds, grounding, points of support, repair. Models are callables from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.operators import graph, relations, retrieve
from docweft.session import durable

#: Characters of a context, the least score of the best chunk, confidence and score below which an answer is a guess.
CONTEXT_CHARS, RELEVANT, CONFIDENT, CLOSE = 4000, 0.15, 0.30, 0.50
#: Points by marks, share of the question's words and words that a point needs, likeness of two points, scored passages.
POINTS, POINT_SHARE, POINT_WORDS, POINT_ALIKE, SCORED = {5: 0, 10: 3, 15: 6}, 0.25, 4, 0.6, 8


def contexts(retrieved: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """``question_id, context``: chunks by rank up to the first that does not fit ``most`` characters."""
    order = Window.partitionBy("question_id").orderBy("rank")
    fits = retrieved.withColumn("_used", F.sum(F.length("content")).over(order)).where(F.col("_used") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    return fits.groupBy("question_id").agg(F.array_join(lines, "\n\n").alias("context"))


def rag_answer(questions: DataFrame, retrieved: DataFrame, answer_with: Callable[[DataFrame], DataFrame], least: float = RELEVANT) -> DataFrame:
    """``question_id, answer, confidence, insufficient, grounded, sources, documents, mean_score, best_score`` of every question.

    ``questions(question_id, question)``, ``retrieved(question_id, chunk_id, document_id, rank, score, content)``. ``answer_with`` takes
    ``question_id, question, evidence`` and adds ``answer, confidence``; it sees only questions whose first chunk is close enough and
    whose context is not blank. An answer is a guess if both its confidence and the best score are low.
    """
    stats = retrieved.groupBy("question_id").agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("document_id").alias("documents"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("score").alias("_best"), F.min_by("score", "rank").alias("_first"))
    met = questions.select("question_id", "question").join(stats, "question_id", "left").join(contexts(retrieved), "question_id", "left")
    known = durable(met.withColumn("_read", F.coalesce((F.col("_first") >= least) & (F.trim("context") != ""), F.lit(False))))
    told = answer_with(known.where("_read").select("question_id", "question", F.col("context").alias("evidence"))).select("question_id", F.col("answer").alias("_a"), F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)).alias("_c"))
    answer = F.coalesce("_a", F.lit(""))
    confidence = F.when(F.col("_read"), F.coalesce("_c", F.lit(0.0))).when(F.col("_first") < least, F.greatest("_first", F.lit(0.0))).otherwise(0.0)
    guess = ~F.col("_read") | (F.trim(answer) == "") | ((F.coalesce("_c", F.lit(0.0)) < CONFIDENT) & (F.col("_best") < CLOSE))
    grounded = F.col("_read") & (F.trim(answer) != "") & F.lower("context").contains(F.lower(F.trim(answer)))
    return known.join(told, "question_id", "left").select(
        "question_id", answer.alias("answer"), F.round(confidence, 6).alias("confidence"), guess.alias("insufficient"), F.coalesce(grounded, F.lit(False)).alias("grounded"),
        F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.round(F.coalesce("_best", F.lit(0.0)), 4).alias("best_score"),
    )


def qa_rerank(candidates: DataFrame, answer_with: Callable[[DataFrame], DataFrame], scored: int = SCORED) -> DataFrame:
    """``question_id, chunk_id, qa, place``: the first ``scored`` passages by a reader's confidence, then the rest in their order.

    ``candidates(question_id, question, chunk_id, rank, content)``; a blank passage or a score that is no number keeps its rank behind.
    """
    ranked = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id")))
    read = ranked.where((F.col("_r") <= scored) & (F.trim("content") != "")).select("question_id", "chunk_id", "question", F.col("content").alias("evidence"))
    told = answer_with(read).select("question_id", "chunk_id", F.when(F.isnan("confidence") | (F.abs("confidence") == float("inf")), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("qa"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc_nulls_last("qa"), "_r")).cast("long")
    return ranked.join(told, ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", "qa", place.alias("place"))


def support_points(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``question_id, block, sentence, place``: evidence sentences that deepen an answer, 0, 3 or 6 by ``marks``.

    ``questions(question_id, question, answer, marks)``, ``blocks(question_id, block, content)``. A point shares a quarter of the question's
    words, has four words or more, no bars, does not restate the answer, and, if it has a digit, holds the question's first word. The best
    is taken and what is too like it goes, in as many rounds as points are asked for: no list of sentences is ever gathered.
    """
    words = lambda c: F.array_distinct(T.words_of(c, T.CONTENT_TOKEN))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv]), F.col("marks").cast("int")), F.lit(0))
    asked = questions.withColumn("_t", T.stems(T.without(T.words_of(F.coalesce("question", F.lit("")), T.CONTENT_TOKEN), V.QUESTION_WORDS))).select("question_id", F.array_distinct("_t").alias("_terms"), F.get("_t", F.lit(0)).alias("_anchor"), T.normalize(F.coalesce("answer", F.lit(""))).alias("_lead"), most.alias("_most"))
    said = blocks.select("question_id", "block", F.posexplode(T.sentences(F.col("content"))).alias("_i", "sentence")).withColumn("_w", words(F.col("sentence"))).where(F.size("_w") >= POINT_WORDS).where(~F.col("sentence").contains("|"))
    met = said.join(asked.where("_most > 0"), "question_id").withColumn("_stems", T.stems(F.col("_w"))).withColumn("_plain", T.normalize(F.col("sentence")))
    share = F.when(F.size("_terms") > 0, F.size(F.array_intersect("_terms", "_stems")) / F.size("_terms")).otherwise(0.0)
    restates = (F.col("_lead") != "") & (F.col("_plain").contains(F.col("_lead")) | F.col("_lead").contains(F.col("_plain")))
    loose = F.col("_anchor").isNotNull() & F.col("sentence").rlike(r"\d") & ~F.array_contains("_stems", F.col("_anchor"))
    fits = met.withColumn("_o", F.round(share, 9)).where(~restates & ~F.coalesce(loose, F.lit(False)) & ((F.size("_terms") == 0) | (F.col("_o") >= POINT_SHARE)))
    left, out = durable(fits.select("question_id", "block", "_i", "sentence", "_w", "_o", "_most")), None
    for k in range(1, max(POINTS.values()) + 1):
        best = durable(left.where(F.col("_most") >= k).groupBy("question_id").agg(F.min(F.struct((-F.col("_o")).alias("o"), "block", "_i", "sentence", "_w")).alias("b")))
        part = best.select("question_id", "b.block", "b.sentence", F.lit(k).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
        if k < max(POINTS.values()):
            alike = F.size(F.array_intersect("_w", "b._w")) / F.size(F.array_union("_w", "b._w")) >= POINT_ALIKE
            left = durable(left.join(best, "question_id").where(~alike).drop("b"))
    return out


def retain_supported(claims: DataFrame, blocks: DataFrame, similar: Column | None = None) -> DataFrame:
    """``answer_id, answer, claims, kept, repaired``: the supported claims of an answer with their sources, if the rest can go.

    ``claims(claim_id, answer_id, place, claim, question, stated)`` in order, ``blocks(answer_id, block, content)``. Claims are judged, those
    with support get the numbers of its blocks before the final punctuation, and what is kept is judged once more with these as stated
    sources. An answer that is fully supported, or whose repair does not pass, stays as it is.
    """
    said = relations.sentences(blocks)  # both rounds judge the same evidence
    told = claims.drop("stated").join(durable(relations.verify_claims(claims, blocks, similar, said)), "claim_id")
    plain = F.trim(T.strip_citations(F.coalesce(F.col("claim"), F.lit(""))))
    mark = F.when(plain.rlike(r"[.!?]\z"), F.right(plain, F.lit(1))).otherwise("")
    body = F.substring(plain, F.lit(1), F.length(plain) - F.length(mark))
    cited = F.concat(body, F.lit(" "), F.array_join(F.transform("supporting", lambda b: F.concat(F.lit("["), b.cast("string"), F.lit("]"))), " "), mark)
    kept = durable(told.withColumn("_good", F.col("label") == relations.SUPPORTED).withColumn("_cited", cited))
    again = relations.verify_claims(kept.where("_good").select("claim_id", "answer_id", F.col("_cited").alias("claim"), "question", F.col("supporting").alias("stated")), blocks, similar, said)
    passed = again.select("claim_id", ((F.col("label") == relations.SUPPORTED) & F.col("citation_ok")).alias("_again"))
    joined = lambda field, sep: F.array_join(F.transform(F.array_sort(F.collect_list(field)), lambda x: x["t"]), sep)
    per = kept.join(passed, "claim_id", "left").groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("_good").alias("kept"), F.bool_and(~F.col("_good") | F.coalesce("_again", F.lit(False))).alias("_passed"),
        joined(F.struct("place", F.coalesce("claim", F.lit("")).alias("t")), " ").alias("_all"), joined(F.when(F.col("_good"), F.struct("place", F.col("_cited").alias("t"))), "\n\n").alias("_kept"),
    )
    repaired = (F.col("kept") > 0) & (F.col("kept") < F.col("claims")) & F.col("_passed")
    return per.select("answer_id", F.when(repaired, F.col("_kept")).otherwise(F.col("_all")).alias("answer"), "claims", "kept", repaired.alias("repaired"))


#: Depth of the candidate pool and its share of ``top_k``, weights of the dense and structural path, of text and graph.
POOL_LEAST, POOL_MOST, POOL_TIMES, PATHS, TEXT_AND_GRAPH = 20, 32, 3, (0.7, 0.3), (0.5, 0.5)


def routed(questions: DataFrame) -> DataFrame:
    """``question_id, path``: the route of ``questions(question_id, route, graph_state)`` where a graph is ready, else ``semantic``; no route means ``both``."""
    path = F.when(F.coalesce(F.col("graph_state") == "available", F.lit(False)), F.coalesce("route", F.lit("both"))).otherwise("semantic")
    return questions.select("question_id", path.alias("path"))


def retrieve_evidence(questions: DataFrame, dense: DataFrame, lexical: DataFrame, structure: DataFrame | None, entity_graph: DataFrame, top_k: int = 5, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``question_id, path, chunk_id, place`` of every question, one plan from streams of ``(question_id, chunk_id, rank)`` to evidence.

    Questions for text fuse the dense and the lexical stream, then the structural path, in a pool deeper than ``top_k``; questions for
    the graph take its stream; questions for both fuse the two. ``rerank`` may reorder the pool: it takes and gives
    ``question_id, chunk_id, rank``.
    """
    paths = durable(routed(questions))
    for_text, for_graph = paths.where("path <> 'graph'").select("question_id"), paths.where("path <> 'semantic'").select("question_id")
    pool = min(POOL_MOST, max(POOL_LEAST, POOL_TIMES * top_k))
    asked = lambda stream, who: stream.select("question_id", "chunk_id", "rank").join(who, "question_id", "left_semi")
    text = retrieve.rrf([(asked(dense, for_text), 1.0), (asked(lexical, for_text), 1.0)], most=pool)
    if structure is not None:
        text = retrieve.rrf([(text, PATHS[0]), (asked(structure, for_text), PATHS[1])], digits=8, most=pool)
    fused = retrieve.rrf([(text, TEXT_AND_GRAPH[0]), (asked(entity_graph, for_graph), TEXT_AND_GRAPH[1])], most=pool).select("question_id", "chunk_id", "rank")
    ordered = fused if rerank is None else rerank(fused)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id")).cast("long")
    return ordered.withColumn("place", place).where(F.col("place") <= top_k).join(paths, "question_id").select("question_id", "path", "chunk_id", "place")


#: Evidence of each stream, of both, and headings above a structural hit.
MOST_SEMANTIC, MOST_STRUCTURAL, MOST_FUSED, MOST_HEADINGS = 8, 8, 12, 3


def fuse_document_evidence(asked: DataFrame, semantic: DataFrame, elements: DataFrame) -> DataFrame:
    """``question_id, stream, id, context, place``: semantic hits, then structural ones with the nearest three headings above them.

    ``asked(question_id, document_id, element_id, rank)``, ``semantic(question_id, id, rank)``, ``elements(document_id, element_id, parent_id,
    heading)``. An element of another document than asked is left out, so evidence cannot leak; ``context`` reads from the top down.
    """
    own = asked.join(elements.select("document_id", "element_id"), ["document_id", "element_id"])
    tree = elements.select(F.col("element_id").alias("id"), "parent_id")
    above = graph.ancestors(own.select(F.col("element_id").alias("node")), tree).where(F.col("depth") <= MOST_HEADINGS)
    named = above.join(elements.select(F.col("element_id").alias("ancestor"), "heading"), "ancestor").groupBy(F.col("node").alias("element_id"))
    contexts_ = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "heading"))), lambda x: x["heading"]), " > ").alias("context"))
    structural = own.join(contexts_, "element_id", "left").select("question_id", F.lit(1).alias("stream"), F.col("element_id").alias("id"), "context", "rank")
    both = semantic.select("question_id", F.lit(0).alias("stream"), "id", F.lit(None).cast("string").alias("context"), "rank").unionByName(structural)
    nth = both.withColumn("_r", F.row_number().over(Window.partitionBy("question_id", "stream").orderBy("rank", "id")))
    kept = nth.where(((F.col("stream") == 0) & (F.col("_r") <= MOST_SEMANTIC)) | ((F.col("stream") == 1) & (F.col("_r") <= MOST_STRUCTURAL)))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("stream", "_r")).cast("long")
    return kept.withColumn("place", place).where(F.col("place") <= MOST_FUSED).select("question_id", "stream", "id", "context", "place")
