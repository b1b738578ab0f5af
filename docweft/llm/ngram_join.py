"""N-gram Jaccard self-join: MinHash LSH forest for candidates, exact verification of every candidate pair.

1. Texts with the same set of five-word shingles are one *set*; its representative is the smallest document that has it.
2. Every set gets ``TREES`` labels of ``DEEPEST`` MinHash values. A tree of the forest is the prefix trie of the sets' labels;
   a node at depth ``d`` holds the sets whose labels agree in the first ``d`` values.
3. Matching starts at the deepest prefix and shortens it value by value, in all trees alike, until the target recall is met
   twice: by the chance of meeting at the threshold itself, and as measured on a bounded sample of documents, whose
   neighbours the signing pass finds exactly among all texts. The forest is built once; depths are prefixes of one label.
4. Members of a node are tied to the node's smallest member (one edge each, never all pairs); connected components of
   these edges are the candidate groups, so a group holds every pair that any node holds.
5. A group is cut into blocks of bounded size along the order of one tree's labels, so that near sets share a block. Two
   blocks meet only if some node has members in both. Inside, intersections of the shingle sets are counted exactly, and
   only sums and spanning edges leave.
6. Verified edges give the final classes.

A hot group is therefore cut into blocks over many tasks, a long chain of near sets meets along the chain only, and no row of
pairs is ever written. What is lost is only what the forest misses at the set recall (0.9999 at exactly 0.8, more above).

Defined cases: documents without words (null, empty, blank) have no links and are their own class; texts of one to four
words are one shingle; repeated rows count as copies; different texts under one id, or without an id, are told apart by
their text; a class whose smallest id is missing or names another class too gets a negative one; an empty table gives an empty result; other columns
are ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.components import components
from docweft.llm.ranks import with_running
from docweft.llm.registry import query
from docweft.llm.shingles import mixed, shingle_sets, slices
from docweft.llm.words import SPACE_RUN
from docweft.session import durable, release, table

#: Fixed value: the threshold as a fraction, so that comparisons stay in integers.
THRESHOLD = (4, 5)
TREES = 32
DEEPEST = 8
RECALL = 0.9999
#: Bytes of one value in a label.
VALUE = 2
#: Rows (id and hash of a text) that may go to every task: 16 bytes each.
MOST_BROADCAST = 1 << 17
#: Documents whose exact neighbours tell the recall of a depth, and their shingles at most.
SAMPLE_DOCS = 128
SAMPLE_SHINGLES = 1 << 20
#: Limits of a verification block.
BLOCK_SETS = 512
BLOCK_SHINGLES = 400_000


def chance(threshold: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair at ``threshold`` shares a node of ``depth`` in one of the trees."""
    return 1 - (1 - threshold**depth) ** trees


def sampled(docs: DataFrame, text: str = "text", docs_at_most: int = SAMPLE_DOCS) -> list[np.ndarray]:
    """Shingle sets of a bounded sample of documents, in the order of a hash of their texts."""
    hashed = docs.where(F.col(text) != "").select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # Only hashes are ordered; each of the few chosen texts then comes once, however often it is repeated.
    chosen = sorted({r["h"] for r in hashed.select("h").orderBy("h").limit(docs_at_most).collect()})
    found = {r["h"]: r["text"] for r in hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("text").alias("text")).collect()} if chosen else {}
    values, bounds = shingle_sets([found[h] for h in chosen])
    out: dict[bytes, np.ndarray] = {}
    size = 0
    for a, b in zip(bounds, bounds[1:], strict=False):
        size += b - a
        if b > a and size <= SAMPLE_SHINGLES:
            out[values[a:b].tobytes()] = values[a:b]
    return list(out.values())


def _signer(trees: int, deepest: int, sample: list[np.ndarray], num: int, den: int):
    """Arrow map: ``doc_id, tk, text`` to ``doc_id, tk, sid, n, labels, near``.

    ``labels``: ``trees`` labels of ``deepest`` values, one after the other; ``near``: per sampled document at the threshold, the
    longest prefix that the two share in any tree.
    """
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 32, size=(trees, deepest), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, size=(trees, deepest), dtype=np.uint64).astype(np.uint32)
    known = np.concatenate([*sample, np.empty(0, dtype=np.uint64)])
    order = np.argsort(known, kind="stable")
    known, whose = known[order], np.repeat(np.arange(len(sample)), [len(v) for v in sample])[order]
    sizes = np.array([len(v) for v in sample], dtype=np.int64)

    def labels_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), trees, deepest), dtype=np.uint16)
        if len(at):
            low = (values >> np.uint64(16)).astype(np.uint32)
            work = np.empty_like(low)
            for t in range(trees):
                for d in range(deepest):
                    np.multiply(low, a[t, d], out=work)
                    np.add(work, b[t, d], out=work)
                    out[:, t, d] = mixed(np.minimum.reduceat(work, at).astype(np.uint64)) & np.uint64(0xFFFF)
        return out

    own = labels_of(np.concatenate([*sample, known[:0]]), np.cumsum(sizes) - sizes)

    def neighbours(values: np.ndarray, n: np.ndarray, labels: np.ndarray, row_of: np.ndarray) -> list[list[int]]:
        """For every text, the shared prefix length with each sampled document at the threshold but itself."""
        out: list[list[int]] = [[] for _ in n]
        if not len(known) or not len(values):
            return out
        owner = np.repeat(np.arange(len(n)), n)
        first, last = np.searchsorted(known, values, "left"), np.searchsorted(known, values, "right")
        hit = np.flatnonzero(last > first)
        count = (last - first)[hit]
        spot = np.repeat(first[hit] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        pair, common = np.unique(np.repeat(owner[hit], count) * len(sample) + whose[spot], return_counts=True)
        i, j = pair // len(sample), pair % len(sample)
        close = ((num + den) * common >= num * (n[i] + sizes[j])) & ~((common == n[i]) & (common == sizes[j]))
        for x, y in zip(i[close].tolist(), j[close].tolist(), strict=True):
            same = np.logical_and.accumulate(labels[row_of[x]] == own[y], axis=1).sum(axis=1)
            out[x].append(int(same.max()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in slices(texts):
                values, bounds = shingle_sets(texts[begin:end])
                n = np.diff(bounds)
                some = n > 0
                labels = labels_of(values, bounds[:-1][some])
                row_of = np.cumsum(some) - 1
                near = neighbours(values, n, labels, row_of)
                sids = [hashlib.blake2b(values[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
                # Big-endian values, so that labels sort as the trie does.
                told = [labels[row_of[i]].astype(">u2").tobytes() if n[i] else None for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        batch.column(1).slice(begin, end - begin),
                        pa.array(sids, pa.binary()),
                        pa.array(n, pa.int64()),
                        pa.array(told, pa.binary()),
                        pa.array(near, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "tk", "sid", "n", "labels", "near"],
                )

    return run


def matched_depth(measured: dict[int, int], threshold: float, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """Longest prefix that meets the recall by its chance at the threshold and on the sample.

    ``measured``: pairs of the sample by the longest prefix that they share in any tree.
    """
    depth, pairs = deepest, sum(measured.values())
    while depth > 1:
        found = sum(n for d, n in measured.items() if d >= depth)
        if chance(threshold, depth, trees) >= recall and found >= recall * pairs:
            break
        depth -= 1
    return depth


def _links(values: np.ndarray, bounds: np.ndarray, block: np.ndarray, first: int, second: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row numbers) at the threshold: within block ``first`` if both are the same, else between the two."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    _, code, seen = np.unique(values, return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    owner, code = owner[shared], code[shared]
    if not len(code):
        return
    _, code = np.unique(code, return_inverse=True)
    columns = int(code.max()) + 1
    left = np.flatnonzero(block == first)
    right = left if first == second else np.flatnonzero(block == second)
    place = np.full(len(n), -1)
    place[right] = np.arange(len(right))
    by_owner = np.searchsorted(owner, np.arange(len(n) + 1))
    order = np.argsort(code, kind="stable")
    order = order[place[owner[order]] >= 0]
    posting, start = place[owner[order]], np.searchsorted(code[order], np.arange(columns + 1))
    lengths = np.diff(start)
    sparse_work = int(lengths[code].sum())
    dense_work = len(left) * len(right) * columns // 12
    strip = 256
    for at in range(0, len(left), strip):
        rows = left[at : at + strip]
        common = np.zeros((len(rows), len(right)), dtype=np.float32)
        if sparse_work <= dense_work:
            for i, row in enumerate(rows):
                mine = code[by_owner[row] : by_owner[row + 1]]
                size = lengths[mine]
                where = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                common[i] = np.bincount(posting[where], minlength=len(right))
        else:
            spot = np.full(len(n), -1)
            spot[rows] = np.arange(len(rows))
            for low in range(0, columns, 2048):
                high = min(columns, low + 2048)
                inside = (code >= low) & (code < high)
                who, what = owner[inside], code[inside] - low
                one, two = spot[who] >= 0, place[who] >= 0
                x, y = np.zeros((len(rows), high - low), dtype=np.float32), np.zeros((len(right), high - low), dtype=np.float32)
                x[spot[who[one]], what[one]] = 1
                y[place[who[two]], what[two]] = 1
                common += x @ y.T
        close = (num + den) * common.astype(np.int64) >= num * (n[rows][:, None] + n[right][None, :])
        close &= rows[:, None] < right[None, :] if first == second else rows[:, None] != right[None, :]
        i, j = np.nonzero(close)
        yield rows[i], right[j]


def _verifier(num: int, den: int):
    """Arrow map over rows sorted by ``task``: ``task, first, second, block, key, sid, copies, text`` to ``key, low, links``."""

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        values, bounds = shingle_sets([r[7] for r in rows])
        own: dict[int, int] = {}
        for i, row in enumerate(rows):  # a text that only shares its hash with the representative is not the set's text
            if row[4] not in own and hashlib.blake2b(values[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() == row[5]:
                own[row[4]] = i
        chosen = [own[r] for r in sorted(own)]
        if len(chosen) < 2:
            return None
        values = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in chosen])
        bounds = np.concatenate([[0], np.cumsum([bounds[i + 1] - bounds[i] for i in chosen])])
        block, copies, keys = (np.array([rows[i][c] for i in chosen], dtype=np.int64) for c in (3, 6, 4))
        links, label = np.zeros(len(chosen), dtype=np.int64), np.arange(len(chosen))
        for i, j in _links(values, bounds, block, rows[0][1], rows[0][2], num, den):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for a, b in zip(*(x.tolist() for x in np.unique(i, return_index=True)), strict=True):
                met = np.unique(np.append(label[j[b : np.searchsorted(i, a, "right")]], label[a]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        hit = np.flatnonzero(links)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(keys[label[hit]]), pa.array(links[hit])], names=["key", "low", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][:3] != row[:3]:
                    if (out := settle(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := settle(held)) is not None:
            yield out

    return run


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tk"), F.col(text).alias("text"))


def _sets(signed: DataFrame) -> DataFrame:
    """One row per shingle set: ``sid, key, rep, at, copies, n, labels``.

    ``key`` is the smallest id that has the set, unless that id stands for another set too or is missing: then a negative
    hash. ``at``: a document that holds it, by id and hash of its text.
    """
    sets = (
        signed.where("sid IS NOT NULL")
        .groupBy("sid")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("doc_id").alias("at_id"), F.first("tk").alias("at_tk"))
    )
    sets = durable(sets)
    twice = sets.groupBy("rep").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1 AND rep IS NOT NULL").select(F.col("rep").alias("_rep"))
    hashed = -F.abs(F.xxhash64("sid") % (1 << 60)) - 1
    return sets.join(twice, F.col("rep") == F.col("_rep"), "left").withColumn("key", F.when(F.col("rep").isNull() | F.col("_rep").isNotNull(), hashed).otherwise(F.col("rep"))).drop("_rep")


def _joined(docs: DataFrame, text: str, threshold: tuple[int, int], trees: int, recall: float) -> DataFrame:
    """``doc_id, tk, sid, copy_id, class_id, n_links, best_id, best_tk`` for every row; the last two name the row that stands for its class."""
    spark = docs.sparkSession
    texts = _keyed(docs, text)
    signer = _signer(trees, DEEPEST, sampled(docs, text), *threshold)
    signed = durable(texts.mapInArrow(signer, "doc_id bigint, tk bigint, sid binary, n bigint, labels binary, near array<int>"))
    measured = {r["d"]: r["k"] for r in signed.select(F.explode("near").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("k")).collect()}
    depth = matched_depth(measured, threshold[0] / threshold[1], trees, recall=recall)
    sets = durable(_sets(signed))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_t")
    label = F.expr(f"substring(labels, _t * {DEEPEST * VALUE} + 1, {depth * VALUE})")
    nodes = sets.select("key", "labels", tree).select("key", F.xxhash64("_t", label).alias("node"))
    # Aggregates are written before they are joined: a hot node or group can then be split over tasks at run time.
    shared = durable(nodes.groupBy("node").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1").select("node", "low"))
    star = nodes.join(shared, "node").where("key <> low").select(F.col("key").alias("u"), F.col("low").alias("v"))
    grouped = components(star)
    roots = grouped.select(F.col("component").alias("node"), "component").distinct()
    member = grouped.unionByName(roots).withColumnRenamed("node", "key").join(sets, "key")
    member = member.select("component", F.expr(f"substring(labels, 1, {DEEPEST * VALUE})").alias("label"), "key", "sid", "copies", "n", "at_id", "at_tk", "labels")
    lined = durable(with_running(member, [F.col("component"), F.col("label"), F.col("key")], {"_ahead": F.col("n")}))
    starts = durable(lined.groupBy("component").agg(F.min("_rank").alias("_r"), F.min("_ahead").alias("_a")))
    # Both numbers grow along the component, so a block is where neither moves on.
    turn = F.floor((F.col("_rank") - F.col("_r")) / BLOCK_SETS) + F.floor((F.col("_ahead") - F.col("_a")) / BLOCK_SHINGLES)
    placed = lined.join(starts, "component").select("component", "key", "sid", "copies", "at_id", "at_tk", "labels", F.xxhash64("component", turn).alias("block"))
    placed = durable(placed)
    several = placed.groupBy("component").agg(F.min("block").alias("_a"), F.max("block").alias("_b"))
    alone = several.where("_a = _b").select(F.col("_a").alias("first"), F.col("_a").alias("second"))
    wide = placed.join(several.where("_a < _b").select("component"), "component").select("block", "labels", tree).select("block", F.xxhash64("_t", label).alias("node"))
    crowd = durable(wide.groupBy("node").agg(F.array_sort(F.collect_set("block")).alias("_bs")))
    pairs = crowd.select("_bs").distinct().select(F.posexplode("_bs").alias("_i", "first"), "_bs").select("first", F.explode(F.slice("_bs", F.col("_i") + 1, F.size("_bs"))).alias("second"))
    tasks = durable(alone.unionByName(pairs.distinct()))
    ends = F.array_distinct(F.array("first", "second"))
    met = tasks.select(F.xxhash64("first", "second").alias("task"), "first", "second", F.explode(ends).alias("block")).join(placed.select("block", "key", "sid", "copies", "at_id", "at_tk"), "block")
    wanted = durable(placed.select("at_id", "at_tk").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted  # else texts are dealt by id
    same = lambda a, b: a["doc_id"].eqNullSafe(b["at_id"]) & (a["tk"] == b["at_tk"])
    with_text = texts.join(wanted, same(texts, wanted), "left_semi")
    ready = (
        met.join(with_text, same(with_text, met))
        .select("task", "first", "second", "block", "key", "sid", "copies", "text")
        .repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), "task")
        .sortWithinPartitions("task", "first", "second", "key")
    )
    verified = durable(ready.mapInArrow(_verifier(*threshold), "key bigint, low bigint, links bigint"))
    classes = durable(components(verified.select(F.col("key").alias("u"), F.col("low").alias("v"))))
    totals = verified.groupBy("key").agg(F.sum("links").alias("links"))
    by_set = (
        sets.select("sid", "key", "copies")
        .join(totals, "key", "left")
        .join(classes.withColumnRenamed("node", "key"), "key", "left")
        .select("sid", "key", F.coalesce("component", "key").alias("_c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    by_set = durable(by_set)
    # The least row of a class by id (missing ones last), then text.
    row = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "tk")
    named = durable(
        signed.where("sid IS NOT NULL").join(by_set.select("sid", "_c"), "sid").groupBy("_c").agg(F.min(row).alias("_best")).select("_c", F.col("_best.doc_id").alias("best_id"), F.col("_best.tk").alias("best_tk"))
    )
    again = named.groupBy("best_id").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(F.col("best_id").alias("_id"))
    class_id = F.when(F.col("best_id").isNull() | F.col("_id").isNotNull(), F.col("_c")).otherwise(F.col("best_id"))
    named_once = named.join(again, F.col("best_id") == F.col("_id"), "left").withColumn("class_id", class_id)
    info = durable(by_set.join(named_once, "_c").select("sid", F.col("key").alias("copy_id"), "class_id", "n_links", "best_id", "best_tk"))
    release(sets, shared, lined, starts, placed, crowd, tasks, verified, classes, by_set, named)
    return signed.join(info, "sid", "left").select("doc_id", "tk", "sid", "copy_id", "class_id", "n_links", "best_id", "best_tk")


def near_duplicates(docs: DataFrame, text: str = "text", threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``doc_id, copy_id, class_id, n_links`` for every row of ``docs``.

    ``copy_id``: smallest id with the same shingle set; ``class_id``: smallest id of the class of linked documents;
    ``n_links``: other documents at the threshold or above, copies included.
    """
    return _joined(docs, text, threshold, trees, recall).select(
        "doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, one each: the smallest id, then the smallest hash of the text, then of the row.

    Rows without words stand for themselves.
    """
    own = docs.columns
    found = _joined(docs, text, THRESHOLD, TREES, RECALL)
    best = found.where("sid IS NOT NULL AND doc_id <=> best_id AND tk = best_tk").select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).distinct()
    ordered = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col(text)).alias("_key"), ordered.alias("_order"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    blank = F.coalesce(F.col(f"_row.`{text}`"), F.lit("")).rlike(f"^{SPACE_RUN}$|^$")
    standing = (F.col("_doc").eqNullSafe(F.col("_id"))) & (F.col("_key") == F.col("_tk"))
    # Repeats are found on narrow rows; whole rows are dealt once, and only those of repeated rows are aggregated.
    narrow = rows.where(~blank).select("_doc", "_key", "_order").join(best, standing, "left_semi").groupBy("_doc", "_key").agg(F.min("_order").alias("_least"), F.count(F.lit(1)).alias("_k"))
    least = durable(narrow.toDF("_id", "_tk", "_least", "_k"))
    met = rows.where(~blank).join(least, standing & (F.col("_order") == F.col("_least")))
    once = met.where("_k > 1").groupBy("_doc", "_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row")
    return met.where("_k = 1").select("_row").unionByName(once).unionByName(rows.where(blank).select("_row")).select("_row.*")


@query("op10_ngram_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at five words and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))
