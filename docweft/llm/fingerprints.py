"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its s-mers lies at its first or last position. That
depends on the k-mer alone, so an edit elsewhere never moves an anchor, and any stretch of ``k - s + 1`` k-mers holds one.
A text's fingerprint has every distinct syncmer hash with the place of its first occurrence, so that it grows with the text
and can be matched by position anywhere. Likeness of two fingerprints is the Jaccard similarity of their anchor sets, exactly;
``shift`` is the most frequent distance between the places of common anchors, so that a match that keeps its position reads 0.

Neighbours are found without a global sort in one task: rows are counted per (id, text), ranked by ranges, and cut into
groups of like numbers of rows whose first keys are known; a group's first document also goes to the group before it (the
very first to the last group), where it only serves as a neighbour. Texts are shuffled once and stream through one Arrow map
that holds two documents at a time. Of rows that repeat more often than a group has rows, one represents all.

Defined cases: null text is an empty text; an empty text has the empty fingerprint, like only another empty one (1.0); a
text without a closed syncmer is one anchor; ids that repeat follow one another by a hash of the text; rows without an id
come first, before the smallest id; a single document is its own next one; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.ranks import with_running
from docweft.llm.registry import query
from docweft.llm.shingles import mixed
from docweft.session import durable, table

#: Code points of a k-mer and of the inner substring: one k-mer in 25 is an anchor.
K = 64
S = 16
#: Hexadecimal digits of a hash in a written fingerprint.
DIGITS = 12
#: Rows of a group, and groups at most (their first keys go to every task: 16 bytes each); beyond that groups grow.
GROUP_ROWS = 2000
MOST_GROUPS = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shift bigint"


def rolling(points: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` code points, by doubling: hash(2w) from hash(w) at two places."""
    value, have, out, done = mixed(points.astype(np.uint64) + np.uint64(1)), 1, None, 0
    left = width
    while left:
        if left & 1:
            out = value if out is None else mixed(out[: len(out) - have] * np.uint64(MULTIPLIER) + value[done:]) if done else out
            done += have
        left >>= 1
        if left:
            value = mixed(value[:-have] * np.uint64(MULTIPLIER) + value[have:])
            have *= 2
    return out


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of a text's code points, in order."""
    if not len(points):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if len(points) < k:
        return rolling(points, len(points)), np.zeros(1, dtype=np.int64)
    inner = rolling(points, s)
    span = k - s + 1
    lowest, have = inner, 1
    while have < span:  # minimum over ``span`` s-mers by doubling
        step = min(have, span - have)
        lowest = np.minimum(lowest[: len(lowest) - step], lowest[step:])
        have += step
    at = np.flatnonzero((inner[: len(lowest)] == lowest) | (inner[span - 1 :] == lowest))
    if not len(at):
        return rolling(points, len(points)), np.zeros(1, dtype=np.int64)
    half = rolling(points, k // 2)
    value = mixed(half[at] * np.uint64(MULTIPLIER) + half[at + k - k // 2])
    return value, at


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchor hashes, ascending, and the first place of each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    value, at = syncmers(points)
    kept, first = np.unique(value, return_index=True)
    return kept, at[first]


def written(part: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash@place`` of every anchor by place, in hexadecimal, joined by commas."""
    order = np.argsort(part[1], kind="stable")
    top = (part[0] >> np.uint64(64 - 4 * DIGITS))[order].tolist()
    return ",".join(f"{h:0{DIGITS}x}@{p:x}" for h, p in zip(top, part[1][order].tolist(), strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, int | None]:
    """Jaccard similarity of the anchor sets, and the most frequent shift of the places of common anchors."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0])), None
    spot = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][spot] == a[0]
    common = int(hit.sum())
    if not common:
        return 0.0, None
    shifts, n = np.unique(b[1][spot[hit]] - a[1][hit], return_counts=True)
    return common / (len(a[0]) + len(b[0]) - common), int(shifts[np.argmax(n)])


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following`` (or all of them)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _router(ids: np.ndarray, hashes: np.ndarray):
    """Arrow map: ``doc_id, k, h, times, text`` to ``part, tail, k, h, doc_id, times, text``.

    ``ids, hashes``: first keys of all groups, ascending. A row goes to the group of its key, and if its key is a group's
    first, as a tail to the group before.
    """
    last = len(ids) - 1

    def group(k: int, h: int) -> int:
        low, high = np.searchsorted(ids, k, "left"), np.searchsorted(ids, k, "right")
        return int(low + np.searchsorted(hashes[low:high], h, "right") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            part = np.searchsorted(ids, k, "right") - 1
            for i in np.flatnonzero(ids[np.maximum(part, 0)] == k):  # keys that share an id with a group's first one
                part[i] = group(int(k[i]), int(h[i]))
            first = (ids[part] == k) & (hashes[part] == h)
            take = np.concatenate([np.arange(len(k)), np.flatnonzero(first)])
            tail = np.arange(len(take)) >= len(k)
            to = np.where(tail, np.where(part[take] > 0, part[take] - 1, last), part[take])
            moved = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(tail), moved.column(1), moved.column(2), moved.column(0), moved.column(3), moved.column(4)], names=["part", "tail", "k", "h", "doc_id", "times", "text"])

    return run


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over ``part, tail, doc_id, times, text`` in order: every row but tails, with the row after it."""
    held, rows = None, []

    def finish(first, second):
        edited = edited_text(first[2], second[2])
        third = sketch(edited)
        near, shift = likeness(first[3], third)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return first[1], len(first[2]), digest, written(first[3]), written(third), near, likeness(first[3], second[3])[0], shift

    def flush():
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            part, tail, doc_id, times, text = (batch.column(c)[i].as_py() for c in range(5))
            now = (part, doc_id, text or "", sketch(text or ""))
            if held is not None and held[0] == part:
                rows.append(finish(held, now))
            held = None if tail else now
            copies = 0 if tail else times - 1  # all but the last of equal rows are followed by their like
            if copies:
                alike = finish(now, now)
                for _ in range(copies):
                    rows.append(alike)
                    if len(rows) >= 500:
                        yield flush()
                        rows = []
            if len(rows) >= 500:
                yield flush()
                rows = []
    if rows:
        yield flush()


def fingerprints(docs: DataFrame, text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses (columns of ``SCHEMA``)."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    keys = durable(base.groupBy("k", "h").agg(F.count(F.lit(1)).alias("m")))
    total = keys.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], SCHEMA)
    size = max(group_rows, -(-total // MOST_GROUPS))
    # Rows that repeat beyond a group's size are few keys; one row with a count stands for each.
    many = durable(keys.where(F.col("m") > size).select(F.col("k").alias("_k"), F.col("h").alias("_h"), "m"))
    here = (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h"))
    plain = base.select("doc_id", "k", "h", F.lit(1).cast("long").alias("times"), "text")
    if many.limit(1).count():
        hot = base.join(F.broadcast(many), here).groupBy("k", "h", "m").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
        plain = plain.join(F.broadcast(many), here, "left_anti").unionByName(hot.select("doc_id", "k", "h", F.col("m").alias("times"), "text"))
    ranked = with_running(keys, [F.col("k"), F.col("h")], {"_before": F.when(F.col("m") > size, 1).otherwise(F.col("m"))})
    cuts = ranked.groupBy(F.floor(F.col("_before") / size).alias("_g")).agg(F.min(F.struct("k", "h")).alias("c")).select("c.*").collect()
    first = np.array(sorted((r["k"], r["h"]) for r in cuts), dtype=np.int64)
    placed = plain.mapInArrow(_router(first[:, 0].copy(), first[:, 1].copy()), "part int, tail boolean, k bigint, h bigint, doc_id bigint, times bigint, text string")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(first), 100_000))
    ready = placed.repartition(parts, "part").sortWithinPartitions("part", "tail", "k", "h").select("part", "tail", "doc_id", "times", "text")
    return ready.mapInArrow(_fingerprint, SCHEMA)


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))
