"""Prefix trie of conversations: nodes that conversations share, their owners, and sums over subtrees.

Conversations are rebuilt first: a conversation ``c`` begins with the first ``h`` turns (``crc32(c) % 4``) of conversation
``c - c % 20`` and goes on with its own turns after its first ``h``. Every distinct sequence of first turns is a node.

1. Turns get their places by a scan over ranges (``runs.along``). A turn becomes a SHA-256 of role and text; texts are shuffled
   once and then gone.
2. The digest of a prefix is the exclusive or, over its turns, of 120 bits of the SHA-256 of (depth, turn), again by a scan, so a
   conversation of any length is dealt over many tasks. *Prefix-digest minima* give each node its smallest member, its owner.
3. Whoever owns a node also owns every deeper one of its conversation. So a conversation's first owned depth is found by
   binary search: each round joins one probe per open conversation with its prefix and with the minima.
4. The nodes that a conversation owns are a chain; chains hang on nodes of other chains and form the tree. Subtree sums of chains
   grow bottom-up by pointer doubling: in each round every chain hands its sum to the chain twice as far up, so a tree of
   height ``n`` takes ``log n`` rounds. Scans from the lower end of each chain then give every node's sums.
5. ``ends_sha256`` streams ids in order: they are joined to pieces inside ranges, and a node's pieces, at most one per range and
   ``PIECE_IDS`` ids, pass through one digest.

Defined cases: null role or text is empty; a null turn comes first; equal turns of one conversation follow role, then text; rows
without a conversation id take no part; a base conversation that is absent gives nothing, one that is shorter gives all it has;
a conversation left without turns is a member of the root only; an empty table has no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.llm.runs import along
from docweft.llm.words import n_words
from docweft.session import durable, release, table

#: Conversations of one base, and base turns at most plus one.
GROUP = 20
HEADS = 4
#: Conversation ids of one piece.
PIECE_IDS = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, place`` (from 1), ``sha, tokens`` of every turn."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("_turn"), F.coalesce(F.col("role"), F.lit("")).alias("_role"), text.alias("_text")).where("conv IS NOT NULL")
    dealt = read.repartitionByRange("conv", F.asc_nulls_first("_turn"), "_role", "_text").sortWithinPartitions("conv", F.asc_nulls_first("_turn"), "_role", "_text")
    sha = F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)
    lined = durable(dealt.select("conv", sha.alias("sha"), n_words(F.col("_text")).alias("tokens"), F.monotonically_increasing_id().alias("_line")))
    return along(lined, "conv", [F.col("_line")], {"place": F.lit(1)}).drop("_line")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, ``conv, depth, sha, tokens`` with a textless depth 0, and ``conv, size`` of each."""
    counted = placed.groupBy("conv").agg(F.max("place").alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") < HEADS, F.struct("place", "sha", "tokens")))).alias("first"))
    counted = durable(counted)
    borrowed = (F.crc32(F.col("conv").cast("string")) % HEADS).cast("int")
    of = counted.select("conv", "n", borrowed.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("_base")).join(counted.select(F.col("conv").alias("_base"), "first"), "_base", "left")
    taken = F.coalesce(F.slice("first", 1, F.col("h")), F.array().cast("array<struct<place:long,sha:string,tokens:long>>"))
    shapes = durable(of.select("conv", "n", "h", taken.alias("_head")).withColumn("gap", F.col("h") - F.size("_head")).withColumn("size", F.size("_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = shapes.select("conv", F.inline("_head")).select("conv", F.col("place").alias("depth"), "sha", "tokens")
    gaps = shapes.where("gap > 0").select("conv", "gap")
    own = placed.where(F.col("place") > F.crc32(F.col("conv").cast("string")) % HEADS).join(gaps, "conv", "left").select("conv", (F.col("place") - F.coalesce("gap", F.lit(0))).alias("depth"), "sha", "tokens")
    roots = shapes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("sha"), F.lit(0).cast("long").alias("tokens"))
    release(counted)
    return heads.unionByName(own).unionByName(roots), shapes.select("conv", F.col("size").cast("long").alias("size"))


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv, depth, tokens`` and the digest ``a, b`` of the conversation's first ``depth`` turns."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "sha"), 256)
    bits = lambda at: F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.conv(F.substring("_d", at, 15), 16, 10).cast("long"))
    hashed = rows.select("conv", "depth", "tokens", digest.alias("_d")).select("conv", "depth", "tokens", bits(1).alias("a"), bits(16).alias("b"))
    return along(hashed, "conv", [F.col("depth")], {"a": F.col("a"), "b": F.col("b")}, "xor")


def minima(prefix: DataFrame) -> DataFrame:
    """``depth, a, b, owner, n_convs, tokens``: each node's smallest member, number of members, words of its last turn."""
    return prefix.groupBy("depth", "a", "b").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("tokens").alias("tokens"))


def owners_at(probes: DataFrame, prefix: DataFrame, nodes: DataFrame) -> DataFrame:
    """``probes(conv, depth, ...)`` with ``owner`` of the conversation's node at that depth."""
    return probes.join(prefix.select("conv", "depth", "a", "b"), ["conv", "depth"]).join(nodes.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).drop("a", "b")


def first_owned(sizes: DataFrame, prefix: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv, size, first``: the first depth that the conversation owns, ``size + 1`` if it owns none."""
    state, done = sizes.select("conv", "size", F.lit(0).cast("long").alias("low"), (F.col("size") + 1).alias("high")), []
    for _ in range(int(sizes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0] + 2).bit_length()):
        probes = state.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        owns = F.col("owner") == F.col("conv")
        halved = owners_at(probes, prefix, nodes).select("conv", "size", F.when(owns, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owns, F.col("depth")).otherwise(F.col("high")).alias("high"))
        state = durable(halved)
        done.append(state.where("low >= high"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("conv", "size", F.col("low").alias("first"))


def subtree_sums(chains: DataFrame) -> DataFrame:
    """``conv`` and, for the whole tree below and with each chain, its ``leaves`` and ``saved``; ``chains`` has ``up``, its parent chain."""
    now = durable(chains.select("conv", "up", "leaves", "saved"))
    while now.where("up IS NOT NULL").limit(1).count():
        handed = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        above = now.select(F.col("conv").alias("up"), F.col("up").alias("_up"))
        more = now.join(handed, "conv", "left").join(above, "up", "left")
        after = durable(more.select("conv", F.col("_up").alias("up"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")))
        release(now)
        now = after
    return now.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        owner, depth, conv = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(conv):
            continue
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])])
        cuts = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, len(conv), PIECE_IDS)]))
        joined = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(owner[cuts]), pa.array(depth[cuts]), pa.array(np.full(len(cuts), part, dtype=np.int32)), pa.array(np.arange(seq, seq + len(cuts))), pa.array(joined, pa.string())], ["owner", "depth", "part", "seq", "ids"])
        seq += len(cuts)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["owner", "depth", "ends_sha256"])

    at, running = None, None
    for batch in batches:
        rows = []
        for owner, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
            if at == (owner, depth):
                running.update(b",")
            else:
                if at:
                    rows.append((*at, running.hexdigest()))
                at, running = (owner, depth), hashlib.sha256()
            running.update(ids.encode())
        yield ended(rows)
    if at:
        yield ended([(*at, running.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """``owner, depth, ends_sha256`` of ``ends(owner, depth, conv)``."""
    order = ["owner", "depth", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "owner long, depth long, part int, seq long, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part", "seq").mapInArrow(_digests, "owner long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    rows, sizes = rebuilt(turns(conversations))
    prefix = durable(prefixes(rows))
    nodes = durable(minima(prefix))
    owned = durable(first_owned(sizes, prefix, nodes))
    chains = owned.where("first <= size")
    hung = owners_at(chains.where("first > 0").select("conv", (F.col("first") - 1).alias("depth")), prefix, nodes).select("conv", F.col("owner").alias("up"), F.col("depth").alias("at"))
    chains = durable(chains.join(hung, "conv", "left"))
    attached = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("_hung"))
    met = nodes.drop("a", "b").join(attached, ["owner", "depth"], "left").join(chains.select(F.col("conv").alias("owner"), "size", "first", "up"), "owner")
    children = F.coalesce("_hung", F.lit(0)) + (F.col("depth") < F.col("size")).cast("long")
    shaped = durable(met.select("owner", "depth", "n_convs", F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("up")).alias("parent"), children.alias("n_children"), (children == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("tokens")).alias("saving")))
    own = shaped.groupBy(F.col("owner").alias("conv")).agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    sums = subtree_sums(chains.select("conv", "up").join(own, "conv"))
    below = chains.where("up IS NOT NULL").join(sums, "conv").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    valued = shaped.join(below, ["owner", "depth"], "left")
    summed = along(valued, "owner", [F.desc("depth")], {"n_leaves": F.col("leaf") + F.coalesce("_leaves", F.lit(0)), "saved_tokens": F.col("saving") + F.coalesce("_saved", F.lit(0))})
    lasts = owned.select("conv", F.col("size").alias("depth"), "first")
    theirs = lasts.where("first <= depth").select(F.col("conv").alias("owner"), "depth", "conv").unionByName(owners_at(lasts.where("first > depth").select("conv", "depth"), prefix, nodes).select("owner", "depth", "conv"))
    out = summed.join(end_digests(theirs), ["owner", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


ORACLE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
  lambda q, y: list_reduce([xor(q, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda w, z: xor(w >> 1, 3988292384 * (w & 1)))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT s.c, t.p, t.r, t.x FROM s JOIN t ON t.c = s.base AND t.p <= s.h UNION ALL SELECT t.c, t.p, t.r, t.x FROM t JOIN s USING (c) WHERE t.p > s.h),
o AS (SELECT c, row_number() OVER w AS d, array_to_string(list(sha256(strlen(r) || ':' || r || x)) OVER w, ' ') AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS tokens FROM b WINDOW w AS (PARTITION BY c ORDER BY p)),
m AS (SELECT c, d, k, tokens, min(c) OVER (PARTITION BY d, k) AS own FROM (SELECT * FROM o UNION ALL SELECT c, 0, '', 0 FROM s)),
n AS (SELECT own, d, count(*) AS n_convs, max(tokens) AS tokens FROM m GROUP BY ALL),
e AS (SELECT m.own, m.d, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends FROM m JOIN (SELECT c, max(d) AS d FROM m GROUP BY c) z USING (c, d) GROUP BY ALL),
u AS (SELECT n.*, m.own AS up FROM n LEFT JOIN m ON m.c = n.own AND m.d = n.d - 1),
k AS (SELECT up AS own, d - 1 AS d, count(*) AS kids FROM u WHERE d > 0 GROUP BY ALL),
f AS (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN k USING (own, d)),
a AS (SELECT m.own, m.d, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n_convs - 1) * f.tokens) AS saved FROM f JOIN m ON m.c = f.own AND m.d <= f.d GROUP BY ALL)
SELECT f.own AS conv_id, f.d::BIGINT AS depth, f.up AS parent_conv_id, f.n_convs, f.kids AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN a USING (own, d) LEFT JOIN e USING (own, d)
"""


@query("op12_prefix_trie", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
