"""Retrieval systems compared under common controls: rows of component flags over shared streams, every stage but the flagged ones alike.

A system takes its base search (dense, or dense and lexical fused), fuses structure and entity graph if flagged, reranks a common number
of seeds, expands them to their topics or to fixed parents if flagged, and fits the sources into the prompt budget of the question's
marks. A component that is missing blocks the system for that question, with the reason; it never changes the experiment silently.
Streams are shared, so a pool is computed once for all systems that use it. The router may keep the graph away from a question where
structure is on, never the base search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import retrieve
from docweft.session import durable

FLAGS = ("hybrid", "structure", "graph", "topic", "parent")
#: The systems compared: which components each has.
SYSTEMS = {
    "dense": (), "hybrid": ("hybrid",), "parent": ("hybrid", "parent"), "graph": ("hybrid", "graph"), "documind_no_topic": ("hybrid", "structure", "graph"),
    "documind_no_graph": ("hybrid", "structure", "topic"), "documind_full": ("hybrid", "structure", "graph", "topic"),
}
#: Weights of semantic and structural path, of text and graph; bytes of topic context; ceilings and answer tokens by marks.
PATHS, TEXT_AND_GRAPH, TOPIC_BYTES, CEILINGS, ANSWERS = (0.7, 0.3), 0.5, 128_000, {5: 8192, 10: 12288, 15: 16384}, {5: 320, 10: 640, 15: 1024}
#: Bytes of the instructions before a question, tokens reserved around a prompt, least characters of a source, tokens below which no more is tried.
INSTRUCTIONS, RESERVED, SHORTEST, FULL = 2048, 512, 40, 80
#: Bytes that a source may have in a prompt at most: two for each token of the largest ceiling.
MOST_BYTES = 2 * max(CEILINGS.values())
MEASURED, BLOCKED = "measured_retrieval_only", "blocked"


@dataclass(frozen=True)
class Controls:
    candidate_depth: int = 32
    seeds: int = 8
    context_ceiling: int = 16384
    graph_hops: int = 3
    parent_target_tokens: int = 1024

    def __post_init__(self):
        if not (1 <= self.seeds <= min(20, self.candidate_depth) and self.candidate_depth <= 32):
            raise ValueError("seeds must be 1 to 20 and no more than the candidate depth, which is at most 32")
        if not (2048 <= self.context_ceiling <= 32768 and 1 <= self.graph_hops <= 3 and self.parent_target_tokens > 0):
            raise ValueError("context, graph or parent controls are out of range")


def first(stream: DataFrame, most: int) -> DataFrame:
    """``question_id, chunk_id, rank`` of the first ``most`` different chunks of a stream."""
    once = stream.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("_r"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("_r", "chunk_id")).cast("long")
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("question_id", "chunk_id", "rank")


def fuse_graph(primary: DataFrame, graph: DataFrame, most: int) -> DataFrame:
    """``question_id, chunk_id, rank``: text and graph by reciprocal ranks, ties by the better rank, then the chunk."""
    key = ["question_id", "chunk_id"]
    part = lambda r: F.coalesce(TEXT_AND_GRAPH / (60 + F.col(r)), F.lit(0.0))
    met = primary.withColumnRenamed("rank", "_p").join(graph.withColumnRenamed("rank", "_g"), key, "full").withColumn("_s", part("_p") + part("_g"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("_s"), F.least("_p", "_g"), "chunk_id")).cast("long")
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select(*key, "rank")


def pools(questions: DataFrame, dense: DataFrame, lexical: DataFrame, structure: DataFrame, graph: DataFrame, depth: int) -> DataFrame:
    """``system, question_id, chunk_id, rank`` of ``questions(question_id, route)``: the candidates of every system before they are reranked."""
    asked = questions.select("question_id")
    own = lambda stream, who=asked: stream.select("question_id", "chunk_id", "rank").join(who, "question_id", "left_semi")
    near = durable(first(own(dense), depth))
    hybrid = durable(retrieve.rrf([(near, 1.0), (first(own(lexical), depth), 1.0)], most=depth).select("question_id", "chunk_id", "rank"))
    both = durable(retrieve.rrf([(hybrid, PATHS[0]), (first(own(structure), depth), PATHS[1])], digits=8, most=depth).select("question_id", "chunk_id", "rank"))
    linked = durable(first(own(graph), depth))
    routed = own(linked, questions.where("coalesce(route, 'both') <> 'semantic'").select("question_id"))
    out = None
    for system, flags in SYSTEMS.items():
        pool = (both if "structure" in flags else hybrid) if "hybrid" in flags else near
        if "graph" in flags:
            pool = fuse_graph(pool, routed if "structure" in flags else linked, depth)
        part = pool.select(F.lit(system).alias("system"), "question_id", "chunk_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _with(flag: str) -> Column:
    return F.col("system").isin([s for s, flags in SYSTEMS.items() if flag in flags])


def topics(seeds: DataFrame, chunks: DataFrame, most: int = TOPIC_BYTES) -> DataFrame:
    """``system, question_id, chunk_id, place``: seeds with the chunks of their contiguous range of one topic, in document order.

    ``seeds(system, question_id, chunk_id, place)``, ``chunks(chunk_id, document_id, chunk_index, topic, bytes)``. A seed without topic
    takes its neighbours, one without a row stays alone. A range is opened by its first seed; later seeds of it add themselves only. What
    does not fit under ``most`` bytes is left out, seeds never are.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    begins = ~F.col("topic").eqNullSafe(F.lag("topic").over(order)) | (F.row_number().over(order) == 1)
    placed = chunks.withColumn("_before", F.coalesce(F.lag("chunk_index").over(order), F.lit(-1))).withColumn("_range", F.sum(begins.cast("int")).over(order))
    one = Window.partitionBy("document_id", "_range")
    placed = durable(placed.withColumn("_lo", F.min("_before").over(one).cast("long")).withColumn("_sum", F.sum("bytes").over(one.orderBy("chunk_index", "chunk_id"))))
    known = placed.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi")
    row = ["document_id", "chunk_index", "chunk_id", "bytes"]
    of_topic = known.where("topic IS NOT NULL").select(F.col("chunk_id").alias("seed"), "document_id", "_range", "_lo").join(placed.select("_range", "_sum", *row), ["document_id", "_range"])
    window = F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")
    beside = known.where("topic IS NULL").select(F.col("chunk_id").alias("seed"), "document_id", (F.col("chunk_index") - 2).cast("long").alias("_lo"), window).join(placed.select(*row), ["document_id", "chunk_index"])
    beside = beside.withColumn("_sum", F.sum("bytes").over(Window.partitionBy("seed").orderBy("chunk_index", "chunk_id")))
    cols = ["seed", "document_id", "_lo", "chunk_index", "chunk_id", "bytes"]
    rows = durable(of_topic.where((F.col("_sum") <= most) | (F.col("chunk_id") == F.col("seed"))).select(*cols).unionByName(beside.where((F.col("_sum") <= most) | (F.col("chunk_id") == F.col("seed"))).select(*cols)))
    ranges = rows.select("seed", "document_id", "_lo").distinct()
    found = seeds.withColumnRenamed("chunk_id", "seed").join(ranges, "seed", "left")
    opened = found.withColumn("_nth", F.row_number().over(Window.partitionBy("system", "question_id", "document_id", "_lo").orderBy("place")))
    whole = opened.where("_nth = 1 AND document_id IS NOT NULL").select("system", "question_id", "place", "seed").join(rows.select("seed", "chunk_index", "chunk_id", "bytes"), "seed")
    alone = opened.where("_nth > 1 OR document_id IS NULL").select("system", "question_id", "place", F.lit(0).cast(rows.schema["chunk_index"].dataType).alias("chunk_index"), F.col("seed").alias("chunk_id"), F.lit(0).cast(rows.schema["bytes"].dataType).alias("bytes"))
    every = whole.drop("seed").unionByName(alone).join(seeds.select("system", "question_id", "chunk_id", F.lit(True).alias("_seed")), ["system", "question_id", "chunk_id"], "left")
    kind = seeds.schema["chunk_id"].dataType.simpleString()
    listed = every.groupBy("system", "question_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_index", "chunk_id", F.col("bytes").cast("long").alias("bytes"), F.coalesce("_seed", F.lit(False)).alias("seed")))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))
    add = lambda s, x: F.struct((s["used"] + x["bytes"]).alias("used"), F.concat(s["ids"], F.array(x["chunk_id"])).alias("ids"))
    fits = lambda s, x: ~F.array_contains(s["ids"], x["chunk_id"]) & (x["seed"] | (s["used"] + x["bytes"] <= most))
    kept = listed.select("system", "question_id", F.aggregate("_all", start, lambda s, x: F.when(fits(s, x), add(s, x)).otherwise(s))["ids"].alias("_ids"))
    return kept.select("system", "question_id", F.posexplode("_ids").alias("place", "chunk_id")).select("system", "question_id", "chunk_id", (F.col("place") + 1).cast("long").alias("place"))


def parents(seeds: DataFrame, chunks: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """``system, question_id, chunk_id, place`` of all chunks of the seeds' parents, and ``system, question_id`` that lack tokens.

    ``chunks(chunk_id, document_id, chunk_index, tokens)``: a parent is a run of a document by where a chunk's tokens begin, ``target`` apart;
    a chunk may reach into the next. A document with a chunk without tokens has no parents.
    """
    whole = Window.partitionBy("document_id")
    starts = F.sum("tokens").over(whole.orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    bad = F.count_if(F.col("tokens").isNull() | (F.col("tokens") <= 0)).over(whole)
    cut = durable(chunks.select("chunk_id", "document_id", "chunk_index", F.floor(starts / target).alias("_parent"), bad.alias("_bad")))
    own = seeds.join(cut.select("chunk_id", "document_id", "_parent", "_bad"), "chunk_id", "left")
    lacking = own.groupBy("system", "question_id").agg(F.max("_bad").alias("_bad")).where("_bad IS NULL OR _bad > 0").select("system", "question_id")
    wanted = own.where("_bad = 0").select("system", "question_id", "document_id", "_parent").distinct()
    rows = wanted.join(cut.select("document_id", "_parent", "chunk_index", "chunk_id"), ["document_id", "_parent"])
    place = F.row_number().over(Window.partitionBy("system", "question_id").orderBy("document_id", "chunk_index", "chunk_id")).cast("long")
    return rows.select("system", "question_id", "chunk_id", place.alias("place")).join(lacking, ["system", "question_id"], "left_anti"), lacking


def json_bytes(c: Column) -> Column:
    """Bytes of a text inside the quotes of a JSON string."""
    return F.octet_length(F.regexp_replace(F.regexp_replace(c, r'["\\\x08\f\n\r\t]', "xx"), r"[\x00-\x1f]", "xxxxxx")).cast("long")


def measures(texts: DataFrame) -> DataFrame:
    """``chunk_id, mark, chars, label, bytes, ends`` of ``texts(chunk_id, document, page, content)``: what fitting needs of a source.

    ``mark`` names equal texts, ``label`` counts bytes of the JSON line without number and text, ``bytes`` those of the text; ``ends`` are
    the bytes after each closed sentence, from ``SHORTEST`` characters on and as far as a prompt can reach.
    """
    body = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")
    label = F.octet_length(F.concat(F.lit('{"source": , "document": "", "page": , "text": ""}'), F.coalesce(F.col("document").cast("string"), F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("null"))))
    told = texts.select("chunk_id", body.alias("_b"), label.cast("long").alias("label"))
    closed = F.filter(T.sentences(F.substring("_b", 1, 2 * MOST_BYTES)), lambda s: s.rlike(r"[.!?]\z"))  # a cut sentence would end behind all that fits
    sizes = F.transform(closed, lambda s: F.struct(F.length(s).alias("chars"), json_bytes(s).cast("int").alias("bytes")))
    start = F.struct(F.lit(-1).alias("chars"), F.lit(-1).alias("bytes"), F.array().cast("array<int>").alias("ends"))

    def joined(a: Column, x: Column) -> Column:
        chars, bytes_ = a["chars"] + 1 + x["chars"], a["bytes"] + 1 + x["bytes"]
        ends = F.when((chars >= SHORTEST) & (bytes_ <= MOST_BYTES), F.concat(a["ends"], F.array(bytes_))).otherwise(a["ends"])
        return F.struct(chars.alias("chars"), bytes_.alias("bytes"), ends.alias("ends"))

    ends = F.aggregate(sizes, start, joined)["ends"]
    return told.select("chunk_id", F.xxhash64("_b").alias("mark"), F.length("_b").cast("long").alias("chars"), "label", json_bytes(F.col("_b")).alias("bytes"), ends.alias("ends"))


def fit(sources: DataFrame, room: DataFrame, measured: DataFrame) -> DataFrame:
    """``system, question_id, place, chunk_id, whole, same_as``: the sources that a prompt holds, in order.

    ``sources(system, question_id, chunk_id, place)``, ``room(question_id, room)`` in estimated tokens (two bytes each), ``measured`` from
    ``measures``. A source that does not fit gives its first closed sentences that do; one that repeats a whole earlier source names it;
    one of less than ``SHORTEST`` characters is left out; no more is tried once less than ``FULL`` tokens are left.
    """
    kind = sources.schema["chunk_id"].dataType.simpleString()
    met = sources.join(measured, "chunk_id").groupBy("system", "question_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "mark", "chars", "label", "bytes", "ends"))).alias("_all"))
    met = met.join(room, "question_id")
    start = F.struct(F.col("room").cast("long").alias("left"), F.array().cast(f"array<struct<chunk_id:{kind},mark:bigint,whole:boolean,same_as:int>>").alias("kept"))
    digits = lambda n: F.length(n.cast("string"))
    tokens = lambda b: F.ceil(b / 2)

    def step(s: Column, x: Column) -> Column:
        number = F.size(s["kept"]) + 1
        same = F.array_position(F.transform(s["kept"], lambda k: F.when(k["whole"] & k["same_as"].isNull(), k["mark"])), x["mark"]).cast("int")
        same = F.when(same > 0, same)
        base = x["label"] + digits(number)
        whole = tokens(base + F.when(same.isNull(), x["bytes"]).otherwise(digits(same) + 10))  # "sameTextAsSource": n for "text": ""
        end = F.array_max(F.filter(x["ends"], lambda e: tokens(base + e) <= s["left"]))
        fits = whole <= s["left"]
        cut = ~fits & same.isNull() & end.isNotNull()
        taken = (s["left"] >= FULL) | (F.size(s["kept"]) == 0)
        more = lambda w, cost: F.struct((s["left"] - cost).cast("long").alias("left"), F.concat(s["kept"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), x["mark"].alias("mark"), F.lit(w).alias("whole"), same.alias("same_as")))).alias("kept"))
        return F.when(taken & fits & (x["chars"] >= SHORTEST), more(True, whole)).when(taken & cut, more(False, tokens(base + end))).otherwise(s)

    kept = met.select("system", "question_id", F.posexplode(F.aggregate("_all", start, step)["kept"]).alias("_i", "_k"))
    return kept.select("system", "question_id", (F.col("_i") + 1).cast("long").alias("place"), "_k.chunk_id", "_k.whole", "_k.same_as")


def compare(
    questions: DataFrame, dense: DataFrame, lexical: DataFrame, structure: DataFrame, graph: DataFrame, chunks: DataFrame, texts: DataFrame,
    rerank: Callable[[DataFrame], DataFrame], controls: Controls = Controls(),
) -> DataFrame:
    """``system, question_id, marks, configuration, status, reason, place, chunk_id, whole, same_as``: the sources that every system supplies.

    ``questions(question_id, question, marks, route, graph_state)``; streams ``(question_id, chunk_id, rank)``;
    ``chunks(chunk_id, document_id, chunk_index, topic, tokens, bytes)``; ``texts(chunk_id, document, page, content)``. ``rerank`` adds
    ``score`` to ``question_id, chunk_id``: a score that is missing or no number blocks the system for that question. A system that is blocked, or supplies
    nothing, has one row without a source. Blank questions and unknown marks are refused by leaving them out.
    """
    marked = F.create_map(*[F.lit(x) for pair in CEILINGS.items() for x in pair])
    answers = F.create_map(*[F.lit(x) for pair in ANSWERS.items() for x in pair])
    known = questions.where((F.trim(F.coalesce("question", F.lit(""))) != "") & F.col("marks").isin(list(CEILINGS)))
    cap, answer = F.least(F.lit(controls.context_ceiling), F.element_at(marked, F.col("marks").cast("int"))), F.element_at(answers, F.col("marks").cast("int"))
    fixed = F.ceil((INSTRUCTIONS + F.octet_length("question")) / 2) + 32
    known = known.withColumn("_fixed", fixed).withColumn("_answer", F.least(answer, F.greatest(F.lit(0), cap - RESERVED - fixed - 200))).withColumn("_budget", F.greatest(F.lit(0), cap - F.col("_answer") - RESERVED))
    known = durable(known.select("question_id", "marks", "route", (F.col("graph_state") == "available").alias("_ready"), ((F.col("_answer") >= 64) & (F.col("_fixed") + 100 <= F.col("_budget"))).alias("_roomy"), (F.col("_budget") - F.col("_fixed")).alias("room")))
    key = ["system", "question_id"]
    found = durable(pools(known, dense, lexical, structure, graph, controls.candidate_depth))
    scored = durable(rerank(found.select("question_id", "chunk_id").distinct()).select("question_id", "chunk_id", F.col("score").cast("double").alias("score")))
    ranked = found.join(scored, ["question_id", "chunk_id"], "left").withColumn("_bad", F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "rank")).cast("long")
    placed = ranked.withColumn("place", place).withColumn("_failed", F.bool_or("_bad").over(Window.partitionBy(*key)))
    placed = durable(placed.where((F.col("place") <= controls.seeds) | F.col("_failed")).select(*key, "chunk_id", "place", "_failed"))
    failed = placed.where("_failed").select(*key).distinct()
    systems = F.explode(F.array(*[F.lit(s) for s in SYSTEMS])).alias("system")
    runs = known.select(systems, "*").join(failed.withColumn("_failed", F.lit(True)), key, "left")
    seeds = durable(placed.where("NOT _failed").select(*key, "chunk_id", "place").join(runs.where(~_with("graph") | F.col("_ready")).select(*key), key, "left_semi"))
    wide, lacking = parents(seeds.where(_with("parent")), chunks, controls.parent_target_tokens)
    values = seeds.where(~_with("topic") & ~_with("parent")).unionByName(topics(seeds.where(_with("topic")), chunks)).unionByName(wide)
    values = durable(values.join(known.where("_roomy").select("question_id"), "question_id", "left_semi"))
    named = texts.join(values.select("chunk_id").distinct(), "chunk_id", "left_semi")
    supplied = fit(values, known.select("question_id", "room"), durable(measures(named)))
    reason = (
        F.when(_with("graph") & ~F.coalesce("_ready", F.lit(False)), "complete_graph_snapshot_required").when(F.col("_failed"), "common_reranker_not_ready")
        .when(F.col("_lacking"), "fixed_parent_token_metadata_missing").when(~F.col("_roomy"), "question_leaves_no_room")
    )
    held = "|".join(f"{k}={v}" for k, v in asdict(controls).items())
    flags = F.create_map(*[F.lit(x) for s, on in SYSTEMS.items() for x in (s, "|".join(f"{f}={f in on}" for f in FLAGS))])
    configuration = F.sha2(F.concat_ws("|", "system", F.element_at(flags, F.col("system")), F.col("marks").cast("string"), F.lit(held)), 256)
    told = runs.join(lacking.withColumn("_lacking", F.lit(True)), key, "left").select(*key, "marks", configuration.alias("configuration"), reason.alias("reason"))
    told = told.withColumn("status", F.when(F.col("reason").isNull(), MEASURED).otherwise(BLOCKED))
    return told.join(supplied, key, "left").select(*key, "marks", "configuration", "status", "reason", "place", "chunk_id", "whole", "same_as")
