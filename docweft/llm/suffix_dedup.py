"""Removal of repeated 400-byte strings: content-defined shards, each sorted by external induced sorting.

A string of ``WIDTH`` bytes has one *anchor*: its smallest k-mer by hash, the leftmost of equals. Equal strings have their
anchors at the same place, so strings can be dealt out by anchor and only strings with equal anchors ever need to meet.

1. Neighbouring strings of a text share their anchor; each such run is one *span* of bytes. One Arrow map turns a document
   into spans (two per ``WIDTH`` bytes or so) with a hash of the anchor and one of the span.
2. Equal spans are one *class*; a class of two or more repeats as a whole. A class that is alone with its anchor ends here:
   nothing in it repeats elsewhere.
3. Where one anchor has several classes, one representative of each class, with its bytes, goes to the anchor's shard.
   A shard concatenates them and finds, by induced suffix sorting with common-prefix values, every position whose next
   ``WIDTH`` bytes also start elsewhere. Anchors of very many classes are dealt anew by offset and by the bytes around the
   anchor. Shards are worked off in parts of whole keys; a key too large for memory is sorted in scratch files.
4. Covered ranges go back from classes to all their spans, are merged per document, and cut out.

Every step is linear in the number of spans; equal spans are reduced before they travel, so a passage of a million copies
travels once. No threshold, cap or sample drops a match.

Defined cases: null text is the empty text; texts under ``WIDTH`` bytes lose nothing; repeated rows are copies of one
another; null ids are kept as such; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.induced_sort import repeated
from docweft.llm.registry import query
from docweft.llm.shingles import mixed, slices
from docweft.session import durable, reclaim, release, table

#: Fixed value: bytes of a repeated string.
WIDTH = 400
#: Bytes of an anchor (a multiple of 8); bytes of text in one part of a shard.
ANCHOR = 32
PART_BYTES = 3 << 19
#: Classes of one anchor from which on it is dealt anew, by blocks of anchor offsets and the bytes all strings of a block share.
HOT_CLASSES = 256
OFFSETS = 16
SLICE = 1 << 20
#: Words of a passage ("over 50 words") and of its anchor.
PASSAGE = 51
WORD_ANCHOR = 8
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
INVERSE = np.uint64(pow(int(ODD[0]), -1, 1 << 64))


def runs(value: np.ndarray, n: int, lengths: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: first start, last start, place and hash of the anchor.

    ``value`` has a hash for every start of ``gram`` units in a concatenation of ``n`` units, texts of ``lengths``; a string
    has ``width`` units. No string crosses texts.
    """
    grams = n - gram + 1
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (value >> bits << bits) | np.arange(grams, dtype=np.uint64)
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    ends = np.cumsum(lengths)
    begins = ends - lengths
    inside = np.zeros(n + 1, dtype=np.int8)
    long = lengths >= width
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    valid = np.cumsum(inside[: len(low)], dtype=np.int8) > 0
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    return first, last, place[first], value[place[first]]


def anchors(data: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` over bytes: ``data`` is a concatenation of texts of ``lengths``."""
    n = len(data)
    none = np.empty(0, dtype=np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64)
    grams = n - ANCHOR + 1
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), shape=(n, 8), strides=(1, 1)).copy().view(np.uint64).ravel()
    value = eight[:grams] * ODD[0]
    for k in range(1, ANCHOR // 8):
        value += eight[8 * k : 8 * k + grams] * ODD[k]
    return runs(mixed(value), n, lengths, width, ANCHOR)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: ``doc_id, tk, text`` to ``doc_id, tk, lo, size, anchor, span``."""
    for batch in batches:
        ids, keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
        missing = np.array([not v.is_valid for v in batch.column(0)])
        for begin, end in slices(texts, SLICE):
            encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts[begin:end]]
            lengths = np.array([len(e) for e in encoded], dtype=np.int64)
            whole = b"".join(encoded)
            first, last, place, gram = anchors(np.frombuffer(whole, dtype=np.uint8), lengths)
            owner = np.searchsorted(np.cumsum(lengths), first, side="right")
            lo = first - (np.cumsum(lengths) - lengths)[owner]
            size = last - first + WIDTH
            view = memoryview(whole)
            span = np.fromiter((xxhash.xxh3_64_intdigest(view[f : f + s]) for f, s in zip(first.tolist(), size.tolist(), strict=True)), dtype=np.uint64, count=len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[begin:end][owner], pa.int64(), mask=missing[begin:end][owner]) if len(owner) else pa.array([], pa.int64()),
                    pa.array(keys[begin:end][owner].astype(np.int64)),
                    pa.array(lo.astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(gram.view(np.int64)),
                    pa.array(span.view(np.int64)),
                ],
                names=["doc_id", "tk", "lo", "size", "anchor", "span"],
            )


def ranges(starts: np.ndarray, width: int = WIDTH) -> list[tuple[int, int]]:
    """Merged byte ranges that strings at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    lows = starts[np.concatenate([[0], cut + 1])]
    highs = starts[np.concatenate([cut, [len(starts) - 1]])] + width
    return list(zip(lows.tolist(), highs.tolist(), strict=True))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: ``anchor, span, hot, bytes`` to ``key, anchor, span, base, bytes``, the key being the shard's.

    Equal strings have their anchor at the same offset. Strings of a hot anchor whose offsets lie in one block of
    ``OFFSETS`` all hold the same core around the anchor, so they can only be equal if their cores are.
    """
    for batch in batches:
        out: list[list] = [[], [], [], [], []]

        def put(*row):
            for column, value in zip(out, row, strict=True):
                column.append(value)

        for anchor, span, hot, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not hot:
                put(anchor, anchor, span, 0, data)
                continue
            *_, places, _ = anchors(np.frombuffer(data, dtype=np.uint8), np.array([len(data)]))
            at, starts = int(places[0]), len(data) - WIDTH
            for block in range((at - starts) // OFFSETS, at // OFFSETS + 1):
                low, high = max(0, at - block * OFFSETS - OFFSETS + 1), min(starts, at - block * OFFSETS)
                core = data[at - block * OFFSETS : at - block * OFFSETS - OFFSETS + 1 + WIDTH]
                key = xxhash.xxh3_64_intdigest(core, seed=(anchor + block) & 0xFFFFFFFF)
                put(key - (1 << 63), anchor, span, low, data[low : high + WIDTH])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "anchor", "span", "base", "bytes"])


def _sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over rows sorted by ``key``: ``key, anchor, span, base, bytes`` to ``anchor, span, covered``."""
    folder = tempfile.mkdtemp(prefix="shard-")

    def work(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        sizes = np.array([len(r[4]) for r in rows], dtype=np.int64)
        joined = np.frombuffer(b"\x00".join(r[4] for r in rows) + b"\x00", dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = joined + np.uint8(1)  # bytes of UTF-8 end below 255
        text[begins + sizes] = 0
        hit = np.flatnonzero(repeated(text, WIDTH, folder))
        owner = np.searchsorted(begins, hit, side="right") - 1
        out: list[list] = [[], [], []]
        for i in np.unique(owner).tolist():
            own = hit[np.searchsorted(owner, i) : np.searchsorted(owner, i, side="right")] - begins[i]
            out[0].append(rows[i][1])
            out[1].append(rows[i][2])
            out[2].append([{"lo": a + rows[i][3], "hi": b + rows[i][3]} for a, b in ranges(own)])
        if not out[0]:
            return None
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names=["anchor", "span", "covered"])

    try:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= PART_BYTES and held[-1][0] != row[0]:
                    if (out := work(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held and (out := work(held)) is not None:
            yield out
    finally:
        for name in os.listdir(folder):
            os.unlink(os.path.join(folder, name))
        os.rmdir(folder)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: ``doc_id, n_passage_words, text, spots`` to the digest of what is left."""
    for batch in batches:
        ids, words, texts, spots = (batch.column(i) for i in range(4))
        rows: list[list] = [[], [], [], []]
        for i in range(batch.num_rows):
            data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for spot in sorted((s["lo"], s["hi"]) for s in spots[i].as_py() or []):
                if merged and spot[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], spot[1])
                else:
                    merged.append(list(spot))
            digest, at = hashlib.sha256(), 0
            for lo, hi in merged:
                digest.update(data[at:lo])
                at = hi
            digest.update(data[at:])
            for column, value in zip(rows, (len(data), sum(b - a for a, b in merged), len(merged), digest.hexdigest()), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(rows, types, strict=True)], words], names=names)


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, tk, spots``: the byte ranges to remove of every text that has any (``tk``: hash of the text)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tk"), F.col(text).alias("text"))
    spans = durable(keyed.mapInArrow(_spans, "doc_id bigint, tk bigint, lo int, size int, anchor bigint, span bigint"))
    # Any span of a class may stand for it; the four values are those of one row.
    at = [F.first(n).alias(n) for n in ("doc_id", "tk", "lo", "size")]
    classes = durable(spans.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("_n"), *at))
    reclaim(spark)
    # Joins read written tables on both sides, so that a hot anchor or class can be split over tasks at run time.
    several = durable(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_least")).where("_c > 1 AND _least = 1").select("anchor", (F.col("_c") > HOT_CLASSES).alias("hot")))
    chosen = classes.join(several, "anchor").select("anchor", "span", "hot", "doc_id", "tk", "lo", "size")
    of_doc = chosen.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("anchor", "span", "hot", "lo", "size")).alias("_want"))
    met = keyed.join(of_doc.withColumnsRenamed({"doc_id": "_d", "tk": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tk") == F.col("_t")))
    data = met.select(F.encode("text", "UTF-8").alias("_b"), "_want").select("_b", F.explode("_want").alias("_w"))
    bytes_ = data.select("_w.anchor", "_w.span", "_w.hot", F.expr("substring(_b, _w.lo + 1, _w.size)").alias("bytes"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    dealt = bytes_.mapInArrow(_dealt, "key bigint, anchor bigint, span bigint, base int, bytes binary")
    shards = dealt.repartition(parts, "key").sortWithinPartitions("key", "anchor", "span", "base")
    covered = durable(shards.mapInArrow(_sorted_shard, "anchor bigint, span bigint, covered array<struct<lo:int,hi:int>>"))
    reclaim(spark)
    whole = classes.where("_n > 1").select("anchor", "span", F.lit(True).alias("_whole"))
    part = covered.groupBy("anchor", "span").agg(F.flatten(F.collect_list("covered")).alias("covered"))
    verdict = durable(whole.join(part, ["anchor", "span"], "full"))
    found = spans.join(verdict, ["anchor", "span"])
    own = F.when(F.col("_whole"), F.array(F.struct(F.col("lo").alias("lo"), (F.col("lo") + F.col("size")).alias("hi")))).otherwise(
        F.transform("covered", lambda c: F.struct((c["lo"] + F.col("lo")).alias("lo"), (c["hi"] + F.col("lo")).alias("hi")))
    )
    spots = durable(found.select("doc_id", "tk", F.explode(own).alias("_s")).groupBy("doc_id", "tk").agg(F.collect_set("_s").alias("spots")))
    release(spans, classes, several, covered, verdict)
    return spots


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (split at ASCII white space), concatenated, and the number of words of each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.fromiter((len(s) for s in split), dtype=np.int64, count=len(split))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for s in split for w in s]
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, dtype=np.uint64)), counts


def word_anchors(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` over words: strings of ``PASSAGE`` words, anchors of ``WORD_ANCHOR`` words."""
    n = len(words)
    none = np.empty(0, dtype=np.int64)
    if n < PASSAGE:
        return none, none, none, none.astype(np.uint64)
    grams = n - WORD_ANCHOR + 1
    value = words[:grams] * ODD[0]
    for k in range(1, WORD_ANCHOR):
        value = mixed(value) + words[k : k + grams] * ODD[k % len(ODD)]
    return runs(mixed(value), n, counts, PASSAGE, WORD_ANCHOR)


def _word_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: ``dk, text`` to ``dk, lo, size, anchor, span``, in words."""
    for batch in batches:
        keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for begin, end in slices(texts, SLICE):
            words, counts = word_hashes(texts[begin:end])
            first, last, _, gram = word_anchors(words, counts)
            owner = np.searchsorted(np.cumsum(counts), first, side="right")
            lo = first - (np.cumsum(counts) - counts)[owner]
            size = last - first + PASSAGE
            view = memoryview(words.tobytes())
            span = np.fromiter((xxhash.xxh3_64_intdigest(view[8 * f : 8 * (f + s)]) for f, s in zip(first.tolist(), size.tolist(), strict=True)), dtype=np.uint64, count=len(first))
            columns = [keys[begin:end][owner], lo.astype(np.int32), size.astype(np.int32), gram.view(np.int64), span.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dk", "lo", "size", "anchor", "span"])


def _word_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: ``text, want`` (spans of the text) to ``anchor, span, low, high, windows``, a hash of every string of a span."""
    for batch in batches:
        texts, wants = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for text, want in zip(texts, wants, strict=True):
            words, _ = word_hashes([text])
            # A polynomial of all words up to each place: a string's hash comes from two of its values.
            factor = np.cumprod(np.full(len(words) + 1, ODD[0]))
            inverse = np.cumprod(np.full(len(words) + 1, INVERSE))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(words) * factor[:-1])])
            for w in want:
                starts = np.arange(w["lo"], w["lo"] + w["size"] - PASSAGE + 1)
                hashed = mixed((sums[starts + PASSAGE] - sums[starts]) * inverse[starts])
                for column, value in zip(out, (w["anchor"], w["span"], w["low"], w["high"], hashed.view(np.int64)), strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["anchor", "span", "low", "high", "windows"])


def passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, tk, n_passage_words``: words of a text inside strings of ``PASSAGE`` words that another document holds too.

    Exact, over whole texts; texts without such a string have no row. Rows of equal id and text are one document here. Spans
    of words are dealt by their anchor like spans of bytes. A class of spans that two documents hold is repeated as a whole;
    where classes of one anchor differ, their strings meet by hash. All strings of a span hold its anchor, so what is repeated
    of a span is one range.
    """
    spark = docs.sparkSession
    tk = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tk.alias("tk"), F.col(text).alias("text")).withColumn("dk", F.xxhash64("doc_id", "tk"))
    every = durable(keyed.select("dk", "text").mapInArrow(_word_spans, "dk bigint, lo int, size int, anchor bigint, span bigint"))
    # Most anchors lie in one document only; what follows works on the spans of the others.
    met_twice = durable(every.groupBy("anchor").agg(F.min("dk").alias("_l"), F.max("dk").alias("_h")).where("_l < _h").select("anchor"))
    spans = durable(every.join(met_twice, "anchor", "left_semi"))
    release(every, met_twice)
    # Any span of a class may stand for it; the three values are those of one row.
    at = [F.first(n).alias(f"at_{n}") for n in ("dk", "lo", "size")]
    classes = durable(spans.groupBy("anchor", "span").agg(F.min("dk").alias("low"), F.max("dk").alias("high"), *at))
    several = durable(
        classes.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("_c"), F.bool_or(F.col("low") == F.col("high")).alias("_single"))
        .where("_c > 1 AND _single")
        .select("anchor")
    )
    want = F.struct("anchor", "span", "low", "high", F.col("at_lo").alias("lo"), F.col("at_size").alias("size"))
    of_doc = durable(classes.join(several, "anchor").groupBy(F.col("at_dk").alias("_k")).agg(F.collect_list(want).alias("_want")))
    one = keyed.select("dk", "text").join(of_doc, F.col("dk") == F.col("_k"))
    windows = durable(one.select("text", "_want").mapInArrow(_word_windows, "anchor bigint, span bigint, low bigint, high bigint, windows array<bigint>"))
    each = windows.select("anchor", "span", "low", "high", F.posexplode("windows").alias("_o", "_w"))
    shared = durable(each.groupBy("anchor", "_w").agg(F.min("low").alias("_l"), F.max("high").alias("_h")).where("_l < _h").select("anchor", "_w"))
    part = each.where("low = high").join(shared, ["anchor", "_w"], "left_semi").groupBy("anchor", "span").agg(F.min("_o").alias("_from"), (F.max("_o") + PASSAGE).alias("_to"))
    whole = classes.where("low < high").select("anchor", "span", F.lit(0).alias("_from"), F.lit(None).cast("int").alias("_to"))
    verdict = durable(whole.unionByName(part))
    found = spans.join(verdict, ["anchor", "span"]).select("dk", (F.col("lo") + F.col("_from")).alias("lo"), (F.col("lo") + F.coalesce("_to", "size")).alias("hi"))
    ranges_ = F.array_sort(F.collect_set(F.struct("lo", "hi")))
    covered = F.aggregate(
        "_r",
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")),
        lambda s, r: F.struct(F.greatest(s["at"], r["hi"]).alias("at"), (s["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(s["at"], r["lo"]))).alias("n")),
    )
    counted = found.groupBy("dk").agg(ranges_.alias("_r")).select("dk", covered["n"].cast("long").alias("n_passage_words"))
    out = durable(keyed.select("doc_id", "tk", "dk").distinct().join(counted, "dk").select("doc_id", "tk", "n_passage_words"))
    release(spans, classes, several, of_doc, windows, shared, verdict)
    return out


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words`` for every row of ``docs``.

    ``n_passage_words`` (see ``passages``) tells of shorter repeats, which are counted and not removed.
    """
    spots = removed(docs, text)
    reclaim(docs.sparkSession)
    words = passages(docs, text).withColumnsRenamed({"doc_id": "_d", "tk": "_t"})
    reclaim(docs.sparkSession)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tk") == F.col("_t"))
    both = spots.join(words, same, "full").select(F.coalesce("doc_id", "_d").alias("_id"), F.coalesce("tk", "_t").alias("_tk"), "spots", "n_passage_words")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    met = keyed.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_tk")), "left")
    read = met.select("doc_id", F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"), "text", "spots")
    return read.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 400-byte strings, and its words in shared passages."""
    return dedup(table(spark, sf_dir, "documents"))
