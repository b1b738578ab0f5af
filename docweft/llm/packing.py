"""Packing token sequences by cutting-stock column generation.

1. Tokenise every document once, in Arrow batches. Pieces of a full sequence are cut off the front; what is left (1 to 2047
   ids) is the document's *rest*. Only lengths and checksums leave the tokeniser, never ids.
2. Count rests by length class (a class is ``UNIT`` lengths wide and stands for its longest). The histogram has at most
   256 rows, whatever the corpus.
3. Solve the cutting-stock linear program over patterns (how many rests of each class fill one sequence): a small revised
   simplex whose columns are priced by an unbounded-knapsack dynamic program over the duals.
4. Round the pattern counts down, pack what they leave by best fit decreasing over the histogram, and lay the patterns out
   as runs of sequence numbers.
5. Rank the rests of each class and hand rank ``r`` its sequence and slot by arithmetic on the run that holds ``r``.
   Ranks come from counts per (class, salt) plus a rank inside each salt, so no class is ranked by one task.

Tokens: ids come from the public byte-level BPE vocabulary (50,257 entries) by its rank form, several times faster than the
``tokenizers`` file. With ``added`` they equal that file's plain call, which finds its added tokens (``<|endoftext|>``)
inside texts; without it these strings are ordinary text. Tests hold both forms together. Id 1 ends every document.

Defined cases: null text is an empty text and packs as its end id alone; very long texts are tokenised whole; repeated
rows are packed as often as they come; an empty table gives an empty result; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.llm.shingles import slices
from docweft.session import durable, table

#: Fixed values.
SEQUENCE = 2048
END_ID = 1
UNIT = 8
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
GAP = 5e-4
#: Salts that share the ranking of one length class: their number follows the pieces, up to a table that is safe to broadcast.
SALTS = (64, 4096)
PIECES_PER_SALT = 500_000
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def vocabulary(name: str = RANKS):
    """Path and split pattern of a vocabulary file, from the installed package that describes them."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def added_tokens(name: str = TOKENIZER) -> dict[str, int]:
    """Added tokens of a ``tokenizers`` file by string; they are matched as they stand."""
    with open(vocabulary(name)[0], encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that are not matched as they stand: {odd}")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str, pattern: str, added: dict[str, int] | None = None):
    """``text -> ids``; texts are split at the strings of ``added`` first, other special strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    made = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return (lambda text: made.encode(text, allowed_special="all")) if added else made.encode_ordinary


_ENCODERS: dict[tuple, object] = {}


def _cutter(path: str, pattern: str, sequence: int, added: dict[str, int]):
    """Arrow map: ``doc_id, text`` to pieces of at most ``sequence`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path, pattern, *sorted(added.items())
        if key not in _ENCODERS:  # kept for the worker's next tasks
            _ENCODERS[key] = encoder(path, pattern, added)
        encode = _ENCODERS[key]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in slices(texts):
                rows: list[list] = [[], [], [], [], []]
                for i in range(begin, end):
                    tokens = np.array([*encode(texts[i] or ""), END_ID], dtype="<u4")
                    for at in range(0, len(tokens), sequence):
                        part = tokens[at : at + sequence]
                        for column, value in zip(rows, (ids[i], at, len(part), zlib.crc32(part.tobytes()), len(tokens)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern for ``duals[w - 1]`` per piece of width ``w``: its value and counts (unbounded knapsack)."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        widths = min(room, len(duals))
        value = duals[:widths] + best[room - 1 :: -1][:widths]
        w = int(np.argmax(value))
        best[room], pick[room] = best[room - 1], 0
        if value[w] > best[room] + 1e-12:
            best[room], pick[room] = value[w], w + 1
    counts, room = np.zeros(len(duals), dtype=np.int64), capacity
    while room > 0:
        if pick[room]:
            counts[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan steps with row pivots: small matrices need no threads of a linear algebra library."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        best = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, best]] = work[[best, i]]
        work[i] /= work[i, i]
        others = work[:, i].copy()
        others[i] = 0
        work -= others[:, None] * work[i]
    return work[:, n:]


def solve(demand: np.ndarray, capacity: int, most_rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns with fractional counts that cut ``demand[w - 1]`` pieces of width ``w`` from fewest stocks of ``capacity``.

    Revised simplex with an explicit basis inverse, begun with one pattern per width. It stops when no pattern prices above
    1, or when the cost is within ``GAP`` of a lower bound (the total width, or the cost over the best price).
    """
    live = np.flatnonzero(demand)
    if not len(live):
        return []
    m = len(live)
    patterns = [np.zeros(m, dtype=np.int64) for _ in range(m)]
    for i, w in enumerate(live):
        patterns[i][i] = capacity // (w + 1)
    inverse = np.diag([1.0 / patterns[i][i] for i in range(m)])
    need = demand[live].astype(float)
    x = inverse @ need
    bound = float(need @ (live + 1)) / capacity
    for turn in range(most_rounds):
        if turn and turn % 200 == 0:
            inverse = inverted(np.array(patterns, dtype=float).T)
            x = np.maximum(inverse @ need, 0)
        duals = np.zeros(capacity)
        duals[live] = np.maximum(inverse.sum(axis=0), 0)
        value, counts = price(duals, capacity)
        bound = max(bound, float(x.sum()) / max(value, 1.0))
        if value <= 1 + 1e-7 or x.sum() <= bound * (1 + GAP):
            break
        entering = counts[live]
        direction = inverse @ entering
        steps = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(steps))
        if not np.isfinite(steps[out]):
            break
        x = np.maximum(x - steps[out] * direction, 0)
        x[out] = steps[out]
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = entering
    whole = []
    for pattern, amount in zip(patterns, x, strict=True):
        full = np.zeros(len(demand), dtype=np.int64)
        full[live] = pattern
        whole.append((full, float(amount)))
    return whole


def rounded(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole pattern counts that use every piece exactly once: the program rounded down, the remainder by best fit."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    for pattern, amount in solve(demand, capacity):
        used = np.flatnonzero(pattern)
        if len(used) and (times := min(int(amount + 1e-9), int((left[used] // pattern[used]).min()))) > 0:
            out.append((pattern, times))
            left -= times * pattern
    while left.any():  # each round fills one pattern greedily from the widest piece and repeats it while pieces last
        pattern, room = np.zeros_like(left), capacity
        for w in np.flatnonzero(left)[::-1]:
            take = min(int(left[w]), room // (int(w) + 1))
            if take:
                pattern[w] = take
                room -= take * (int(w) + 1)
        used = np.flatnonzero(pattern)
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(class, first rank, end rank, first sequence, per sequence, slots before)`` for every use of a class in a pattern.

    The list's length follows the number of patterns, not of pieces.
    """
    demand = np.zeros(capacity, dtype=np.int64)
    for width, count in histogram.items():
        demand[width - 1] = count
    out, used, sequence = [], np.zeros(capacity, dtype=np.int64), 0
    for pattern, times in rounded(demand, capacity):
        before = 0
        for w in np.flatnonzero(pattern)[::-1]:
            k = int(pattern[w])
            out.append((int(w) + 1, int(used[w]), int(used[w] + k * times), sequence, k, before))
            used[w] += k * times
            before += k
        sequence += times
    return out


def pieces(docs: DataFrame, text: str = "text", sequence: int = SEQUENCE, added: bool = False) -> DataFrame:
    """Pieces of every document: full sequences first, then its rest."""
    path, pattern = vocabulary()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cutter(path, pattern, sequence, added_tokens() if added else {}), PIECE)


def pack(docs: DataFrame, text: str = "text", sequence: int = SEQUENCE, unit: int = UNIT, added: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece.

    Rests come first in the numbering of sequences, full pieces after them with one sequence each. ``added``: match the
    tokenizer file's added tokens inside texts.
    """
    spark = docs.sparkSession
    cut = pieces(docs, text, sequence, added)
    # Equal pieces of repeated rows are one row with a count: ranks are given to the row, places to its copies.
    kind = F.when(F.col("length") == sequence, F.lit(0)).otherwise(F.ceil(F.col("length") / unit)).cast("int")
    cut = durable(cut.groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("_m")).withColumn("_tag", F.xxhash64("doc_id", "start", "ids_crc32")).withColumn("_class", kind))
    salts = min(SALTS[1], max(SALTS[0], cut.count() // PIECES_PER_SALT))
    cut = cut.withColumn("_salt", F.pmod("_tag", F.lit(salts)).cast("int"))
    counts = durable(cut.groupBy("_class", "_salt").agg(F.sum("_m").alias("_n")))
    before = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_class", "_salt", "_shift")
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    histogram.pop(0, 0)
    capacity = sequence // unit
    laid = runs(histogram, capacity)
    total = max((f + (e - b) // k for _, b, e, f, k, _ in laid), default=0)
    # Bounded: classes x salts, and at most a few runs per pattern of the program.
    order = Window.partitionBy("_class", "_salt").orderBy("_tag", "doc_id", "start", "length", "ids_crc32", "doc_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("_in", F.coalesce(F.sum("_m").over(order), F.lit(0))).join(F.broadcast(shift), ["_class", "_salt"])
    ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).withColumn("_rank", F.col("_in") + F.col("_shift") + F.col("_copy"))
    full = ranked.where("_class = 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_rank") + total).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not laid:
        return full
    layout = spark.createDataFrame(laid, "_class int, _from bigint, _to bigint, _first bigint, _per bigint, _slots bigint").groupBy("_class").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_to", "_first", "_per", "_slots"))).alias("_runs")
    )
    rests = ranked.where("_class > 0").join(F.broadcast(layout), "_class")
    run = F.filter("_runs", lambda x: (x["_from"] <= F.col("_rank")) & (F.col("_rank") < x["_to"]))[0]
    rests = rests.withColumn("_run", run).withColumn("_at", F.col("_rank") - F.col("_run._from"))
    rests = rests.withColumn("sequence_id", F.col("_run._first") + F.floor(F.col("_at") / F.col("_run._per"))).withColumn("_slot", F.col("_run._slots") + F.col("_at") % F.col("_run._per"))
    ahead = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = rests.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return placed.select(*full.columns).unionByName(full)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(table(spark, sf_dir, "documents"), added=True)
