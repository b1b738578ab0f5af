"""Evidence put together from chunks and elements, lists, fallback sentences, prompts, snapshots and resumable batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators.retrieve import small
from docweft.session import durable

#: Shortest sentence of a fallback answer, chunks of one resumable batch, rows of one part of a snapshot.
SHORTEST, BATCH, PART = 45, 24, 1000
#: Words that mark a sentence as metadata.
METADATA = ["copyright", "isbn", "published"]
#: Lists that questions meet first, and how many times as many those meet that are left.
FIRST_HEADS, MORE = 128, 16


def topic(rows: DataFrame, cap: int) -> DataFrame:
    """``seed, chunk_id, complete``: a seed and the chunks of its range that fit under ``cap`` bytes, in order; the seed always stays.

    ``rows(seed, chunk_id, place, bytes)`` holds every chunk of the seed's range, the seed too.
    """
    own = F.col("chunk_id") == F.col("seed")
    all_ = Window.partitionBy("seed")
    kept = F.sum(F.when(own, F.col("bytes"))).over(all_)
    others = F.sum(F.when(own, 0).otherwise(F.col("bytes"))).over(all_.orderBy("place", "chunk_id"))
    inside = rows.withColumn("_in", own | (kept + others <= cap)).withColumn("complete", F.bool_and("_in").over(all_))
    return inside.where("_in").select("seed", "chunk_id", "complete")


def structure_evidence(hits: DataFrame, elements: DataFrame, documents: int = 5, most: int = 20) -> DataFrame:
    """``question_id, document_id, element_id, place``: first elements, in sequence, of the documents a question hit best.

    ``hits(question_id, document_id, rank)``, ``elements(document_id, element_id, seq)``.
    """
    best = hits.groupBy("question_id", "document_id").agg(F.min("rank").alias("_r"))
    best = best.withColumn("_d", F.row_number().over(Window.partitionBy("question_id").orderBy("_r", "document_id"))).where(F.col("_d") <= documents)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("seq", "element_id")).cast("long")
    first = elements.withColumn("place", place).where(F.col("place") <= most)
    return best.join(first, "document_id").select("question_id", "document_id", "element_id", "place")


def element_candidates(reached: DataFrame, texts: DataFrame, most: int = 10) -> DataFrame:
    """``root, id, depth, text``: up to ``most`` elements below a seed, nearest first; elements without text are skipped.

    ``reached(root, id, depth)`` comes from ``graph.descendants``, ``texts(id, text)`` hydrates.
    """
    full = reached.join(texts, "id").where(F.trim("text") != "")
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))
    return full.withColumn("_p", place).where(F.col("_p") <= most).select("root", "id", "depth", "text")


def fallback_terms(question: Column) -> Column:
    """Capitalised words of a question behind its first, else all words; of three letters or more, in lower case."""
    words = F.regexp_extract_all(question, F.lit("[A-Za-z0-9]+"), F.lit(0))
    names = F.filter(words, lambda w, i: (i > 0) & w.rlike("^[A-Z]") & (F.length(w) >= 3))
    rest = F.filter(words, lambda w: F.length(w) >= 3)
    return F.array_distinct(F.transform(F.when(F.size(names) > 0, names).otherwise(rest), F.lower))


def fallback(asked: DataFrame) -> DataFrame:
    """``question_id, sentence, overlap, place``: the sentences that answer when no model does.

    ``asked(question_id, question, evidence, most)``. Long enough sentences without metadata words, by shared terms, then
    order; equal ones count once; at most ``most`` of a question.
    """
    sentences = F.transform(F.regexp_extract_all("evidence", F.lit("[^.!?]+[.!?]+"), F.lit(0)), lambda x: F.trim(x))
    each = asked.select("question_id", "most", fallback_terms(F.col("question")).alias("_t"), F.posexplode(sentences).alias("_i", "sentence"))
    words = T.alnum_tokens(F.col("sentence"))
    fit = each.where((F.length("sentence") >= SHORTEST) & (F.size(F.array_intersect(words, F.array(*map(F.lit, METADATA)))) == 0))
    scored = fit.select("question_id", "most", "sentence", "_i", F.size(F.array_intersect("_t", words)).cast("long").alias("overlap"), F.array_join(words, " ").alias("_f"))
    once = scored.groupBy("question_id", "most", "_f").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "_i", "sentence")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("_b.o", "_b._i")).cast("long")
    return once.withColumn("place", place).where(F.col("place") <= F.col("most")).select("question_id", F.col("_b.sentence").alias("sentence"), (-F.col("_b.o")).alias("overlap"), "place")


def lists(lines: DataFrame) -> DataFrame:
    """``document_id, list, heading, item, chunk_id, content``: runs of lines between blank ones; a heading and two items or more.

    ``lines(document_id, chunk_id, chunk_index, content)``.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    runs = lines.withColumn("list", F.sum(F.when(F.trim("content") == "", 1).otherwise(0)).over(order).cast("long")).where(F.trim("content") != "")
    run = Window.partitionBy("document_id", "list")
    placed = runs.withColumn("item", (F.row_number().over(run.orderBy("chunk_index")) - 1).cast("long")).withColumn("heading", F.first("content").over(run.orderBy("chunk_index"))).withColumn("_n", F.count(F.lit(1)).over(run))
    return placed.where("item > 0 AND _n >= 3").select("document_id", "list", "heading", "item", "chunk_id", "content")


def list_answer(asked: DataFrame, items: DataFrame, shared: int = 2) -> DataFrame:
    """``question_id, chunk_id``: the item at the asked place of the only list whose heading shares ``shared`` words or more.

    ``asked(question_id, tokens, position)``, ``items`` as ``lists`` gives them, ``heading`` only needed where ``item`` is 1. Several
    such lists give no answer, so two of them settle a question: questions meet ``FIRST_HEADS`` lists first, those left ``MORE`` times
    as many, and in the end all lists. What meets many lists, by frequent words, has gone by then.
    """
    order = F.xxhash64("document_id", "list").alias("_h")
    heads = durable(items.where("item = 1").select("document_id", "list", F.array_distinct(T.content_tokens(F.col("heading"))).alias("_w"), order))
    words = asked.select("question_id", F.explode("tokens").alias("token"))
    most, least, width = heads.count(), -(1 << 63), 1 << 64

    def met(part: DataFrame) -> DataFrame:
        pairs = words.join(small(part.select("document_id", "list", F.explode("_w").alias("token"))), "token").groupBy("question_id", "document_id", "list").agg(F.count(F.lit(1)).alias("_n"))
        return pairs.where(F.col("_n") >= shared).groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"), F.min("document_id").alias("document_id"), F.min("list").alias("list"))

    size = FIRST_HEADS
    while size < most:
        several = met(heads.where(F.col("_h") < least + width * size // most)).where("_n > 1")
        words = durable(words.join(several.select("question_id"), "question_id", "left_anti"))
        size *= MORE
    at = met(heads).where("_n = 1").join(asked.select("question_id", F.col("position").alias("item")), "question_id")
    return at.join(items, ["document_id", "list", "item"]).select("question_id", "chunk_id")


def prompt(evidence: DataFrame) -> DataFrame:
    """``question_id, prompt``: the question, then numbered evidence under the heading of its group, groups by their best rank.

    ``evidence(question_id, question, grouping, rank, text)`` is a bounded number of rows of a question.
    """
    line = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "text").alias("line"))
    joined = lambda rows, field: F.array_join(F.transform(F.array_sort(rows), lambda x: x[field]), "\n")
    groups = evidence.groupBy("question_id", "question", "grouping").agg(F.min("rank").alias("_r"), joined(F.collect_list(line), "line").alias("_body"))
    block = F.struct("_r", F.concat(F.lit("## "), "grouping", F.lit("\n"), "_body").alias("block"))
    return groups.groupBy("question_id", "question").agg(joined(F.collect_list(block), "block").alias("_all")).select("question_id", F.concat(F.lit("Question: "), "question", F.lit("\n"), "_all").alias("prompt"))


def archive(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``key, part, payload``: rows of a key as canonical JSON, nulls written out, in parts of ``PART`` rows; NaN is refused."""
    kinds = dict(rows.dtypes)
    guarded = [F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}")).cast(kinds[c])).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    parts = rows.select(key, F.floor(F.col(order) / PART).cast("long").alias("part"), F.struct(*guarded).alias("_s"))
    return parts.groupBy(key, "part").agg(F.to_json(F.array_sort(F.collect_list("_s")), {"ignoreNullFields": "false"}).alias("payload"))


def next_batch(items: DataFrame, cursor: DataFrame, most: int = BATCH) -> DataFrame:
    """The next ``most`` rows of every document behind its cursor; from the start where the fingerprint changed.

    ``items(document_id, place, fingerprint, ...)``, ``cursor(document_id, fingerprint, last)``; a document may have no cursor.
    """
    past = cursor.select("document_id", F.col("fingerprint").alias("_f"), F.col("last").alias("_l"))
    open_ = items.join(past, "document_id", "left").where(F.col("_l").isNull() | (F.col("_f") != F.col("fingerprint")) | (F.col("place") > F.col("_l")))
    turn = F.row_number().over(Window.partitionBy("document_id").orderBy("place"))
    return open_.withColumn("_t", turn).where(F.col("_t") <= most).drop("_t", "_f", "_l")


def cursor_after(batch: DataFrame) -> DataFrame:
    """The cursor that a worked-off batch leaves: ``document_id, fingerprint, last``."""
    return batch.groupBy("document_id", "fingerprint").agg(F.max("place").alias("last"))
