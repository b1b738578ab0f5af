"""Structure edges, breadth-first expansion and trees over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.vocabulary import RELATION_PRIORITY, RELATION_WEIGHTS
from docweft.session import durable


def plan_edges(chunks: DataFrame) -> DataFrame:
    """NEXT, PREV, SAME_PAGE and SAME_SECTION edges between near chunks of a document.

    Input: ``document_id, chunk_id, chunk_index, page, topic``. One window gives every chunk its next two; edges are rows of
    an exploded array, so there is one shuffle and no self join. A gap of two does not look at the chunk between.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    near = chunks.select("document_id", "chunk_id", "page", "topic", *[F.lead(c, k).over(order).alias(f"{c}{k}") for k in (1, 2) for c in ("chunk_id", "page", "topic")])
    a, b, d = F.col("chunk_id"), F.col("chunk_id1"), F.col("chunk_id2")

    def edge(when: Column, s: Column, t: Column, relation: str) -> Column:
        return F.when(when & (s != t), F.struct(s.alias("source"), t.alias("target"), F.lit(relation).alias("relation"), F.lit(RELATION_WEIGHTS[relation]).alias("weight")))

    one, two = b.isNotNull(), d.isNotNull()
    page, topic = one & (F.col("page") == F.col("page1")), one & (F.col("topic") == F.col("topic1"))
    topic2 = two & (F.col("topic") == F.col("topic2"))
    edges = [edge(one, a, b, "NEXT"), edge(one, b, a, "PREV"), edge(page, a, b, "SAME_PAGE"), edge(page, b, a, "SAME_PAGE"), edge(topic, a, b, "SAME_SECTION"), edge(topic, b, a, "SAME_SECTION"), edge(topic2, a, d, "SAME_SECTION"), edge(topic2, d, a, "SAME_SECTION")]
    return near.select("document_id", F.explode(F.array_compact(F.array(*edges))).alias("e")).select("document_id", "e.*")


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int | None = 40) -> DataFrame:
    """``seed, node, hops, weight``: nodes within ``hops``; the shortest hop wins, then the larger weight of the last edge.

    ``seeds(seed, node)``, ``edges(source, target, weight)``. Each level joins the frontier with the edges, keeps the best
    edge per node (map-side combined) and drops what was reached before; it is written, so no level is computed twice. ``most`` caps a seed's nodes by (hops, -weight, node).
    """
    reached = seeds.select("seed", "node", F.lit(0).alias("hops"), F.lit(1.0).alias("weight"))
    frontier = reached
    for level in range(1, hops + 1):
        step = frontier.select("seed", "node").join(edges.select(F.col("source").alias("node"), "target", "weight"), "node")
        best = step.groupBy("seed", F.col("target").alias("node")).agg(F.max("weight").alias("weight"))
        frontier = durable(best.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("hops"), "weight"))
        reached = reached.unionByName(frontier)
    if most is None:
        return reached
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("hops", F.desc("weight"), "node"))
    return reached.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def neighbours(seeds: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """One-hop neighbours of ``seeds(seed, node)`` by relation priority, then id, at most ``most`` per seed."""
    order = F.create_map(*[F.lit(x) for kv in RELATION_PRIORITY.items() for x in kv])[F.col("relation")]
    step = seeds.join(edges.select(F.col("source").alias("node"), "target", "relation"), "node").withColumn("_p", order)
    best = step.groupBy("seed", F.col("target").alias("chunk_id")).agg(F.min("_p").alias("_p"))
    best = best.join(seeds.select("seed", F.col("node").alias("chunk_id")), ["seed", "chunk_id"], "left_anti")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("_p", "chunk_id")))
    names = F.element_at(F.array(*[F.lit(k) for k in RELATION_PRIORITY]), (F.col("_p") + 1).cast("int"))
    return ranked.where(F.col("rank") <= most).select("seed", "chunk_id", names.alias("relation"), F.col("rank").cast("long").alias("rank"))


def closure(tree: DataFrame) -> DataFrame:
    """``node, ancestor, depth`` of every node of ``tree(id, parent_id)``, by pointer doubling.

    Round ``k`` knows each node's ancestors within ``2^k`` steps and the one exactly that far up; joining the two doubles both, so a
    chain of ``n`` takes ``log n`` rounds. A walk ends at the root or before an id that it has met, so cycles give each other
    member once. Rounds go on until one adds no pair.
    """
    links = tree.where("parent_id IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("node"), F.col("parent_id").alias("ancestor")).distinct()
    jump = durable(links)
    known, step = durable(links.where("node <> ancestor").withColumn("depth", F.lit(1).cast("long"))), 1
    size = known.count()
    while size:
        above = known.select(F.col("node").alias("_far"), F.col("ancestor").alias("_up"), "depth").unionByName(jump.select(F.col("ancestor").alias("_far"), F.col("ancestor").alias("_up"), F.lit(0).cast("long").alias("depth")).distinct())
        further = jump.withColumnRenamed("ancestor", "_far").join(above, "_far").where("node <> _up").select("node", F.col("_up").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        grown = durable(known.unionByName(further).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        jump = durable(jump.withColumnRenamed("ancestor", "_far").join(jump.select(F.col("node").alias("_far"), "ancestor"), "_far").select("node", "ancestor"))
        known, step, before, size = grown, 2 * step, size, grown.count()
        if size == before:
            break
    return known.select("node", "ancestor", F.col("depth").cast("int").alias("depth"))


def ancestors(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """``node, ancestor, depth`` of ``nodes(node)``, at any depth; a repeated id ends the walk."""
    return closure(tree).join(nodes.select("node").distinct(), "node", "left_semi")


def descendants(roots: DataFrame, tree: DataFrame, deepest: int | None = None, most: int | None = None) -> DataFrame:
    """``root, id, depth`` below ``roots(root)``; ``deepest`` asks for so many levels only, ``most`` for so many by (depth, id)."""
    if deepest is None:
        below = closure(tree).select(F.col("ancestor").alias("root"), F.col("node").alias("id"), "depth").join(roots.select("root").distinct(), "root", "left_semi")
    else:
        reached = frontier = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"))
        for depth in range(1, deepest + 1):
            step = frontier.select("root", F.col("id").alias("parent_id")).join(tree, "parent_id").select("root", "id", F.lit(depth).alias("depth")).distinct()
            frontier = durable(step.join(reached.select("root", "id"), ["root", "id"], "left_anti"))
            reached = reached.unionByName(frontier)
        below = reached.where("depth > 0")
    if most is None:
        return below
    rank = F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))
    return below.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def relation_rows(relations: DataFrame, mentions: DataFrame, entities: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations with the names of both ends and their source, ``owner, rid, subject_id, subject, predicate, object_id, object, quote, chunk_id, content, document_id``.

    Both mentions must agree with the relation in owner, document and chunk, entities and document in owner, the chunk in document.
    """
    ends = relations
    for end in ("subject", "object"):
        at = mentions.select(F.col("mention_id").alias(f"{end}_mention"), F.col("entity_id").alias(f"{end}_id"), "owner", "document_id", "chunk_id")
        names = entities.select(F.col("entity_id").alias(f"{end}_id"), "owner", F.col("name").alias(end))
        ends = ends.join(at, [f"{end}_mention", "owner", "document_id", "chunk_id"]).join(names, [f"{end}_id", "owner"])
    placed = ends.join(chunks.select("chunk_id", "document_id", "content"), ["chunk_id", "document_id"]).join(documents.select("document_id", "owner"), ["document_id", "owner"])
    return placed.select("owner", "rid", "subject_id", "subject", "predicate", "object_id", "object", "quote", "chunk_id", "content", "document_id")


def entity_seeds(questions: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """``question_id, owner, entity_id, name``: entities of the owner that a phrase of ``questions(question_id, owner, question)`` names, longest names first."""
    named = questions.select("question_id", "owner", F.explode(T.phrases(F.col("question"))).alias("_name"))
    met = named.join(entities.select("owner", "entity_id", "name", T.normalize(F.col("name")).alias("_name")), ["owner", "_name"])
    order = Window.partitionBy("question_id").orderBy(F.desc(F.length("_name")), "_name", "entity_id")
    return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("question_id", "owner", "entity_id", "name")


def walk_relations(seeds: DataFrame, rows: DataFrame, hops: int = 3, most_nodes: int = 48, most_rows: int = 128, most: int = 8) -> DataFrame:
    """``question_id, chunk_id, document_id, hops, path, place``: source chunks that factual relations reach from ``seeds``, with the path.

    Messages pass along relations in both directions; each carries its path. Per hop a question reads its first ``most_rows`` relations
    by id (the subject is the anchor, if both ends are in the frontier); a node keeps the path of the first of them, and new nodes join up
    to ``most_nodes``. A chunk whose text holds the relation's quote is evidence, once, by (hops, path).
    ``rows`` are those of ``relation_rows``; a column ``held`` may stand for quote and content.
    """
    visited = durable(seeds.select("question_id", "owner", "entity_id", F.array("name").alias("path")))
    frontier, found = visited, None
    held = F.col("held") if "held" in rows.columns else F.coalesce(F.col("content").contains(F.trim("quote")) & (F.trim("quote") != ""), F.lit(False))
    ends = rows.select("owner", "rid", F.col("subject_id").alias("near"), F.lit(0).alias("_side"), F.col("object_id").alias("far"), F.array("predicate", "object").alias("_step"), "chunk_id", "document_id", held.alias("_held"))
    back = rows.select("owner", "rid", F.col("object_id").alias("near"), F.lit(1).alias("_side"), F.col("subject_id").alias("far"), F.array(F.concat(F.lit("← "), "predicate"), F.col("subject")).alias("_step"), "chunk_id", "document_id", held.alias("_held"))
    # a question's first relations are among the first of each of its nodes, so a hub sends no more than these
    nth = F.dense_rank().over(Window.partitionBy("owner", "near").orderBy("rid"))
    both_ways = durable(ends.unionByName(back).withColumn("_n", nth).where(F.col("_n") <= most_rows).drop("_n"))
    for hop in range(1, hops + 1):
        sent = frontier.select("question_id", "owner", F.col("entity_id").alias("near"), "path").join(both_ways, ["owner", "near"])
        once = sent.withColumn("_o", F.row_number().over(Window.partitionBy("question_id", "rid").orderBy("_side"))).where("_o = 1")
        read = once.withColumn("_o", F.row_number().over(Window.partitionBy("question_id").orderBy("rid"))).where(F.col("_o") <= most_rows)
        read = durable(read.select("question_id", "owner", "rid", "far", F.concat("path", "_step").alias("path"), "chunk_id", "document_id", "_held"))
        told = read.where("_held").select("question_id", "chunk_id", "document_id", F.lit(hop).cast("long").alias("hops"), F.array_join("path", " ").alias("path"))
        found = told if found is None else found.unionByName(told)
        if hop < hops:
            fresh = read.groupBy("question_id", "owner", F.col("far").alias("entity_id")).agg(F.min(F.struct("rid", "path")).alias("_m")).join(visited.select("question_id", "entity_id"), ["question_id", "entity_id"], "left_anti")
            room = visited.groupBy("question_id").agg((most_nodes - F.count(F.lit(1))).alias("_room"))
            ranked = fresh.join(room, "question_id").withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy("_m.rid", "entity_id"))).where("_r <= _room")
            frontier = durable(ranked.select("question_id", "owner", "entity_id", F.col("_m.path").alias("path")))
            visited = visited.unionByName(frontier)
    best = found.groupBy("question_id", "chunk_id", "document_id").agg(F.min(F.struct("hops", "path")).alias("_b")).select("question_id", "chunk_id", "document_id", "_b.hops", "_b.path")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("hops", "document_id", "chunk_id")).cast("long")
    return best.withColumn("place", place).where(F.col("place") <= most)


#: Relations of one chunk at most, and letters of an entity, a predicate and a quote.
MOST_PARSED, ENTITY_CHARS, PREDICATE_CHARS, QUOTE_CHARS = 3, 120, 80, 400


def parse_relations(raw: Column, chunk: Column) -> Column:
    """``array<struct<subject, predicate, object, quote>>`` of a model's JSON list: at most three, each quoted literally from ``chunk``.

    Both ends must stand in the quote and differ; a repeated triple counts once; text that is no such list gives none.
    """
    fields = ("subject", "predicate", "object", "quote")
    items = F.coalesce(F.from_json(raw, f"array<struct<{','.join(f'{n}:string' for n in fields)}>>"), F.array().cast(f"array<struct<{','.join(f'{n}:string' for n in fields)}>>"))
    trimmed = F.transform(items, lambda x: F.struct(*[F.trim(F.coalesce(x[n], F.lit(""))).alias(n) for n in fields]))
    sized = lambda c, most: F.length(c).between(1, most)
    fits = F.filter(
        trimmed,
        lambda x: sized(x["subject"], ENTITY_CHARS) & sized(x["object"], ENTITY_CHARS) & sized(x["predicate"], PREDICATE_CHARS) & sized(x["quote"], QUOTE_CHARS)
        & chunk.contains(x["quote"]) & x["quote"].contains(x["subject"]) & x["quote"].contains(x["object"]) & (F.lower(x["subject"]) != F.lower(x["object"])),
    )
    same = lambda a, b: (a["subject"] == b["subject"]) & (a["predicate"] == b["predicate"]) & (a["object"] == b["object"])
    once = F.filter(fits, lambda x, i: ~F.exists(F.slice(fits, F.lit(1), i), lambda y: same(x, y)))
    return F.slice(once, 1, MOST_PARSED)
