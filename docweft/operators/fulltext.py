"""Full-text search for batches of questions: phrases, AND, OR, NOT, ranked by cover density.

A question is written as in a web search: words must all occur, ``"quoted words"`` must follow one another, ``or`` parts
alternatives, ``-`` before a word or phrase excludes it. A word that holds several tokens (``fr-27``) is a phrase of them.

``positions`` writes the positional index, a row for each word. ``search`` asks every distinct question once and meets the index in tiles
(``operators/covers.py``): a block of questions, a column of chunks. ``find`` does the same without these rows: ``packed`` writes one row
for each chunk, with the numbers and places of the words that a question names. There a question looks only at chunks that hold all words of an
alternative. A cover starts at a start of a unit, and between two occurrences of one unit at most one cover starts at each other unit,
so an alternative of ``m`` units whose least frequent one stands ``n`` times in a chunk adds at most ``WEIGHT * m * n``: chunks of
greatest such bound are ranked first, and of the others only those whose bound reaches the ``k``-th rank by then (an equal bound: with a
smaller id). So nothing that could be among the first ``k`` is left out.

The rank of a chunk sums ``0.1 / (1 + gap)`` over its covers: the shortest stretches that satisfy the question, where ``gap`` counts
the words inside that the question does not name.

Stop words are not indexed but keep their places, so phrases span them. A question that only excludes matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.operators import covers
from docweft.operators.covers import WEIGHT
from docweft.operators.retrieve import small, top
from docweft.session import durable

#: Parts of a question: a phrase in quotes or a run without white space and quotes, either behind a minus.
PARTS = '-?"[^"]*"|[^\\s"]+'

#: Different words of all questions that may go to every task; bytes of texts that are cut into words at a time.
MOST_WORDS, CUT_BYTES = 1 << 18, 1 << 24
#: Tasks that questions and chunks are dealt to, if there are fewer cores.
LEAST_TASKS = 8
#: Which bytes words are made of.
WORD_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def lexeme(word: Column) -> Column:
    return T.stem(word)


def positions(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The index ``lexeme, chunk_id, pos`` of ``chunks(chunk_id, content)``, written; of ``wanted`` lexemes only, if given."""
    words = chunks.select("chunk_id", F.posexplode(T.alnum_tokens(F.col("content"))).alias("pos", "word")).where(~F.col("word").isin(V.QUERY_STOPWORDS))
    # never null, so that the join adds no filter, which would stem every word twice
    index = words.select(F.coalesce(lexeme(F.col("word")), F.lit("")).alias("lexeme"), "chunk_id", F.col("pos").cast("long").alias("pos"))
    if wanted is not None:
        index = index.join(small(wanted.select("lexeme").distinct()), "lexeme", "left_semi")
    return durable(index)


def units(questions: DataFrame) -> DataFrame:
    """``question_id, alt, unit, excluded, place, lexeme, size`` of ``questions(question_id, question)``: a unit is a word or phrase."""
    parts = questions.select("question_id", F.posexplode(F.regexp_extract_all(F.lower("question"), F.lit(PARTS), F.lit(0))).alias("unit", "_part"))
    order = Window.partitionBy("question_id").orderBy("unit")
    dealt = parts.withColumn("alt", F.count_if(F.col("_part") == "or").over(order)).where("_part <> 'or'")
    words = dealt.select("question_id", "alt", F.col("unit").cast("long").alias("unit"), F.col("_part").startswith("-").alias("excluded"), F.posexplode(T.alnum_tokens(F.col("_part"))).alias("place", "_word"))
    kept = words.where(~F.col("_word").isin(V.QUERY_STOPWORDS)).select("question_id", "alt", "unit", "excluded", F.col("place").cast("long").alias("place"), lexeme(F.col("_word")).alias("lexeme"))
    return kept.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("question_id", "unit")))


def anchors(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``question_id, alt, lexeme, step, alts``: the rarest word of every alternative, what one occurrence adds to a bound at most, and
    how many alternatives the question has; alternatives with an absent word have no row."""
    known = counts.groupBy("lexeme").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.where("NOT excluded").join(known, "lexeme", "left").groupBy("question_id", "alt").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "lexeme")).alias("_r"), F.count_distinct("unit").alias("_m"))
    alts = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    return rarest.where("_r.n > 0").select("question_id", "alt", F.col("_r.lexeme").alias("lexeme"), (F.lit(WEIGHT) * F.col("_m")).alias("step"), alts.alias("alts"))


def candidates(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``question_id, alt, chunk_id``: every chunk that holds the rarest word of an alternative."""
    counts = index.groupBy("lexeme", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    return anchors(asked, counts).join(counts, "lexeme").select("question_id", "alt", "chunk_id")


def bounds(asked: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``question_id, chunk_id, bound`` of ``pairs(question_id, chunk_id)``: no density is greater; pairs that cannot match have no row."""
    words = asked.groupBy("question_id", "alt", "unit", "excluded", "size", "lexeme").agg(F.count(F.lit(1)).alias("_times"))
    met = pairs.join(words.select("question_id", "lexeme").distinct(), "question_id").join(counts, ["lexeme", "chunk_id"]).join(words, ["question_id", "lexeme"])
    per = met.groupBy("question_id", "chunk_id", "alt", "unit", "excluded", "size").agg(F.sum("_times").alias("_seen"), F.min("tf").alias("_least"))
    alt = per.where(F.col("_seen") == F.col("size")).groupBy("question_id", "chunk_id", "alt").agg(F.count_if(~F.col("excluded")).alias("_has"), F.min(F.when(~F.col("excluded"), F.col("_least"))).alias("_least"), F.bool_or(F.col("excluded") & (F.col("size") == 1)).alias("_bad"))
    needs = asked.where("NOT excluded").groupBy("question_id", "alt").agg(F.count_distinct("unit").alias("_needs"))
    fit = alt.where("NOT _bad").join(needs, ["question_id", "alt"]).where("_has = _needs")
    return fit.groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.lit(WEIGHT) * F.col("_needs") * F.col("_least")), 6).alias("bound"))


def occurrences(asked: DataFrame, found: DataFrame, index: DataFrame) -> DataFrame:
    """``question_id, chunk_id, unit, start, end``: where units of a question stand in its candidates."""
    words = asked.select("question_id", "lexeme").distinct()
    looked = found.select("question_id", "chunk_id").distinct().join(words, "question_id").join(index, ["lexeme", "chunk_id"])
    placed = looked.join(asked.select("question_id", "unit", "place", "size", "lexeme"), ["question_id", "lexeme"])
    stands = placed.groupBy("question_id", "chunk_id", "unit", (F.col("pos") - F.col("place")).alias("_base"), "size").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    return stands.where("_n = size").select("question_id", "chunk_id", "unit", "start", "end")


def matches(asked: DataFrame, stands: DataFrame) -> DataFrame:
    """``question_id, chunk_id`` where an alternative has all its units and none that it excludes."""
    shape = asked.select("question_id", "alt", "unit", "excluded").distinct()
    needs = shape.groupBy("question_id", "alt").agg(F.count_if(~F.col("excluded")).alias("_needs"))
    has = stands.select("question_id", "chunk_id", "unit").distinct().join(shape, ["question_id", "unit"]).groupBy("question_id", "alt", "chunk_id").agg(F.count_if(~F.col("excluded")).alias("_has"), F.count_if("excluded").alias("_bad"))
    return has.join(needs, ["question_id", "alt"]).where("_has = _needs AND _bad = 0").select("question_id", "chunk_id").distinct()


def cover_density(asked: DataFrame, stands: DataFrame) -> DataFrame:
    """``question_id, chunk_id, density`` from the occurrences of units: the sum over covers, one window per question and chunk.

    At each end of a unit, an alternative reaches back to the least of its units' latest starts; the best alternative's start and the
    first end that reaches it make a cover. ``gap`` is the stretch less the places that units fill.
    """
    shape = asked.where("NOT excluded").select("question_id", "alt", "unit").distinct()
    held = stands.join(asked.where("NOT excluded").select("question_id", "unit").distinct(), ["question_id", "unit"])
    ends = held.select("question_id", "chunk_id", "end").distinct()
    grid = ends.join(shape, "question_id").join(held.groupBy("question_id", "chunk_id", "unit", "end").agg(F.max("start").alias("start")), ["question_id", "chunk_id", "unit", "end"], "left")
    reached = grid.withColumn("_last", F.max("start").over(Window.partitionBy("question_id", "chunk_id", "alt", "unit").orderBy("end")))
    starts = reached.groupBy("question_id", "chunk_id", "alt", "end").agg(F.min("_last").alias("_s"), F.count_if(F.col("_last").isNull()).alias("_open")).where("_open = 0")
    covers = starts.groupBy("question_id", "chunk_id", "end").agg(F.max("_s").alias("start")).groupBy("question_id", "chunk_id", "start").agg(F.min("end").alias("end"))
    filled = asked.where("NOT excluded").select("question_id", "unit", "place").distinct().join(held.withColumn("_base", F.col("start")), ["question_id", "unit"])
    first = Window.partitionBy("question_id", "unit", "chunk_id", "start", "end")
    places = filled.select("question_id", "chunk_id", (F.col("_base") + F.col("place") - F.min("place").over(first)).alias("pos")).distinct()
    marks = covers.select("question_id", "chunk_id", F.col("start").alias("pos"), F.lit(True).alias("_c"), "start", "end").unionByName(covers.select("question_id", "chunk_id", F.col("end").alias("pos"), F.lit(False).alias("_c"), "start", "end"))
    numbered = places.withColumn("_i", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy("pos")))
    spans = marks.join(numbered, ["question_id", "chunk_id", "pos"]).groupBy("question_id", "chunk_id", "start", "end").agg((F.max("_i") - F.min("_i")).alias("_filled"))
    part = F.lit(WEIGHT) / (1 + F.col("end") - F.col("start") - F.col("_filled"))
    return spans.groupBy("question_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("density"))


def ranked(asked: DataFrame, found: DataFrame, index: DataFrame) -> DataFrame:
    """``question_id, chunk_id, score`` of those of ``found(question_id, chunk_id)`` that match, written."""
    stands = durable(occurrences(asked, found, index))
    return durable(cover_density(asked, stands.join(matches(asked, stands), ["question_id", "chunk_id"], "left_semi")).withColumnRenamed("density", "score"))


def _surfaces(known: list[str]) -> tuple[list[str], list[int]]:
    """Every word that is indexed under a lexeme of ``known``, and the lexeme's number: the lexeme itself or with a suffix, if that is cut."""

    def lexeme_of(word: str) -> str:
        return next((word[: len(word) - len(s)] for s in V.SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)

    stop = set(V.QUERY_STOPWORDS)
    pairs = [(w + s, i) for i, w in enumerate(known) for s in ("", *V.SUFFIXES) if w + s not in stop and lexeme_of(w + s) == w]
    return [w for w, _ in pairs], [i for _, i in pairs]


def _cut(text: np.ndarray, starts: np.ndarray, surfaces: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and places of the known words of lower-case texts that follow one another, and where each text's begin; ``starts`` ends with the length."""
    inside = WORD_BYTES[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = starts[:-1][starts[:-1] < starts[1:]]
    first[begins] = inside[begins]
    tokens = np.searchsorted(np.flatnonzero(first), starts)
    cuts = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(text[inside]))
    found = pc.fill_null(pc.index_in(words, surfaces), -1).to_numpy()
    at = np.flatnonzero(found >= 0)
    text_of = np.searchsorted(tokens, at, side="right") - 1
    return numbers[found[at]], (at - tokens[text_of]).astype(np.int32), np.searchsorted(at, tokens)


def packed(chunks: DataFrame, known: list[str]) -> DataFrame:
    """``chunk_id, n, words, places`` of ``chunks(chunk_id, content)``, written: how many words with a lexeme of ``known`` a chunk holds,
    their numbers in ``known`` and their places, as 32-bit integers. Chunks without such a word have no row."""
    surfaces, owners = _surfaces(known)
    surfaces, owners = pa.array(surfaces, pa.string()), np.array(owners, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("chunk_id"), batch.column("text").cast(pa.large_binary())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            row = 0
            while row < len(ids):
                end = max(row + 1, int(np.searchsorted(at, at[row] + CUT_BYTES, side="right")) - 1)
                numbers, places, begins = _cut(data[at[row] : at[end]], at[row : end + 1] - at[row], surfaces, owners)
                n, borders = np.diff(begins), pa.py_buffer((begins * 4).astype(np.int32))
                whole = [pa.Array.from_buffers(pa.binary(), end - row, [None, borders, pa.py_buffer(x)]) for x in (numbers, places)]
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(n), *whole], ["chunk_id", "n", "words", "places"]).filter(pa.array(n > 0))
                row = end

    texts = chunks.where("chunk_id IS NOT NULL AND content IS NOT NULL").select("chunk_id", F.lower("content").cast("binary").alias("text"))
    return durable(texts.mapInArrow(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, n long, words binary, places binary"))


def _answers(asked: DataFrame, words: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``search`` with the numbers ``words(lexeme, word)`` of all words asked, and their ``postings`` as ``covers.best`` takes them."""
    shape = F.sort_array(F.collect_list(F.struct("alt", "unit", "excluded", "place", "word"))).alias("shape")
    posed = durable(asked.where("question_id IS NOT NULL").join(words, "lexeme").groupBy("question_id").agg(shape))
    forms = durable(posed.groupBy("shape").agg(F.min("question_id").alias("form")))
    tasks = max(LEAST_TASKS, asked.sparkSession.sparkContext.defaultParallelism)
    found = top(covers.best(forms.select(F.col("form").alias("question_id"), F.inline("shape")), postings, k, tasks), k)
    return posed.join(forms, "shape").select("question_id", "form").join(found.withColumnRenamed("question_id", "form"), "form").select("question_id", "chunk_id", "score", "rank")


def search(questions: DataFrame, index: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """``question_id, chunk_id, score, rank``: the ``k`` chunks of greatest cover density, ties by chunk."""
    asked = durable(units(questions)) if asked is None else asked
    words = small(durable(asked.select("lexeme").distinct().withColumn("word", F.monotonically_increasing_id())))
    return _answers(asked, words, index.where("chunk_id IS NOT NULL").join(words, "lexeme").select("word", "chunk_id", "pos"), k)


def find(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``search`` of ``chunks(chunk_id, content)`` for the questions whose ``units`` are ``asked``, read twice."""
    known = asked.select("lexeme").distinct().limit(MOST_WORDS + 1).toArrow().column("lexeme")
    if len(known) > MOST_WORDS:  # too many for every task: the index is joined with them
        return search(None, positions(chunks, asked), k, asked)
    known = sorted(known.to_pylist())
    words = asked.sparkSession.createDataFrame(pa.table({"lexeme": pa.array(known, pa.string()), "word": pa.array(range(len(known)), pa.int64())}))
    return _answers(asked, F.broadcast(words), packed(chunks, known), k)
