"""Invariants on tiny hand-made frames."""

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import answers as A
from docweft.operators import chunking as C
from docweft.operators import graph, retrieve, statistics
from docweft.sources import files


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edges_have_no_loops_and_no_repeats(spark):
    chunks = spark.createDataFrame([(1, i, i, i // 2, "a" if i < 3 else None) for i in range(5)], "document_id long, chunk_id long, chunk_index long, page long, topic string")
    edges = graph.plan_edges(chunks).collect()
    keys = [(e.source, e.target, e.relation) for e in edges]
    assert len(set(keys)) == len(keys) and all(s != t for s, t, _ in keys)
    assert (0, 2, "SAME_SECTION") in keys and (3, 4, "SAME_SECTION") not in keys and (0, 1, "SAME_PAGE") in keys and (1, 2, "SAME_PAGE") not in keys


def test_expand_takes_shortest_hop_then_heaviest_edge_and_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.9), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "c", 0.1)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("s", "a")], "seed string, node string")
    assert values(graph.expand(seeds, edges, 3).select("node", "hops", "weight")) == [("a", 0, 1.0), ("b", 1, 0.9), ("c", 1, 0.1)]
    assert graph.expand(seeds, edges, 3, most=2).count() == 2


def test_tree_walks_stop_at_cycles(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "id long, parent_id long")
    nodes = spark.createDataFrame([(4,)], "node long")
    assert values(graph.ancestors(nodes, tree).select("ancestor", "depth")) == [(1, 2), (2, 3), (3, 1)]
    roots = spark.createDataFrame([(3,)], "root long")
    assert {r.id for r in graph.descendants(roots, tree).collect()} == {1, 2, 4}


def test_rank_fusion_sums_streams_and_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "question_id long, chunk_id string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "question_id long, chunk_id string, rank long")
    rows = {r.chunk_id: r for r in retrieve.rrf([(a, 1.0), (b, 1.0)]).collect()}
    assert rows["y"].rank == 1 and rows["y"].paths == 3 and rows["x"].fusion_score == pytest.approx(1 / 61) and rows["z"].paths == 2
    tie = retrieve.rrf([(spark.createDataFrame([(1, "b", 1)], a.schema), 1.0), (spark.createDataFrame([(1, "a", 1)], a.schema), 1.0)]).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["a", "b"]


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([([(1, 50), (2, 80), (3, 40)],)], "items array<struct<id:bigint,tokens:bigint>>")
    row = df.select(retrieve.pack_skip(F.col("items"), 100).alias("p")).first().p
    assert row.used == 90 and row.ids == [1, 3]


def test_question_blocks_give_the_same_top(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(9)], "chunk_id long, v array<double>")
    queries = vectors.select(F.col("chunk_id").alias("question_id"), F.col("v").alias("q"))
    whole = values(retrieve.dense_topk(queries, vectors, 3))
    monkeypatch.setattr(retrieve, "MOST_QUESTIONS", 2)
    assert values(retrieve.dense_topk(queries, vectors, 3)) == whole


def test_auc_and_wilson(spark):
    df = spark.createDataFrame([("a", 1.0, False), ("a", 2.0, True), ("a", 2.0, False), ("a", 3.0, True), ("b", 1.0, True)], "g string, s double, y boolean")
    rows = {r.g: r for r in statistics.auc(df, "s", "y", ["g"]).collect()}
    assert rows["a"].roc_auc == pytest.approx(0.875) and rows["b"].roc_auc is None
    low, high = statistics.wilson(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(low, high).first() == (None, None)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(T.requested_position(lit("the third and the last"))) is None and one(T.requested_position(lit("the last item"))) == -1
    assert one(T.stem(lit("calibrations"))) == "calibr" and one(T.stem(lit("ions"))) == "ions"
    assert one(T.with_citation(lit("It works. "), lit("3"))) == "It works [3]." and one(T.strip_citations(lit("a [1] b [12]."))) == "a b."
    assert one(T.support_ratio(lit("built in 1859 [2]"), lit("It was built in 1859. Yes"))) == 1.0
    assert one(T.numbers_supported(lit("5 and 7"), lit("5 only"))) is False
    assert one(T.sanitize_filename(lit("a/b/..<x>.txt. "))) == "_x_.txt" and one(T.sanitize_filename(lit("a/.. "))) == "unnamed"
    assert one(T.resolve_followup(lit("why?"), lit("What is X"))) == "What is X why?" and one(T.resolve_followup(lit("why?"), lit(""))) == "why?"
    assert one(T.csv_safe(lit("=1+1"))) == "'=1+1" and one(T.token_estimate(lit(""))) == 0 and one(T.token_estimate(lit("abc"))) == 1


def test_legacy_windows_cover_the_text_and_keep_the_suffix_tail():
    text = "".join(f"Sentence number {i} is here. " for i in range(90))
    windows = C.legacy_windows(text)
    assert all(w in text for w in windows) and all(len(w) <= 1000 for w in windows) and windows[-2].endswith(windows[-1])
    assert C.legacy_windows("short") == ["short"]


def test_structure_chunks():
    para = {"kind": "paragraph", "path": "A > B", "page": 1}
    chunks = C.structure_chunks([{**para, "content": "word " * 30}, {**para, "content": "more " * 30}, {**para, "content": "x. " * 900, "page": 2}, {"kind": "table", "path": "", "page": 2, "content": "h1|h2\n" + "\n".join(f"{i}|{'c' * 40}" for i in range(60))}])
    assert chunks[0]["how"] == "merge" and chunks[0]["content"].startswith("A > B\n\n")
    split = [c for c in chunks if c["how"] == "split"]
    assert len(split) > 1 and all(c["tokens"] <= C.MOST for c in split) and "".join(c["content"].removeprefix("A > B\n\n") for c in split) == "x. " * 900
    tables = [c for c in chunks if c["how"] == "table"]
    assert len(tables) > 1 and all(c["content"].startswith("h1|h2\n") for c in tables) and sum(c["content"].count("\n") for c in tables) == 60


def test_answer_rules():
    assert A.sentences("See e.g. this one. Then\nthat follows. End") == ["See e.g. this one.", "Then that follows.", "End"]
    assert A.claims("- First point. [1]\n```\n[x]\n```\n[2]\nSecond point.") == ["First point.", "Second point."]
    assert A.promote_parts(["explain osmosis", "define diffusion"], ["intro text", "diffusion spreads", "osmosis moves water"]) == [2, 1, 0]
    prompt = A.fit_prompt("q", ["same text here", "same text here", "z" * 5000], ["old", "new"], 200)
    assert prompt["used"] <= 200 and '"same_as": 1' in prompt["evidence"][1] and prompt["history"] == ["old", "new"]
    assert A.validate_bytes(b"", "txt") == "empty" and A.validate_bytes(b"%PDF-1", ".PDF") == "" and A.validate_bytes(b"PK", "docx") == "no zip archive"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "=cmd"), (2, 'say "x", y\nz')], "k long, t string")
    assert values(files.round_trip(df, "json", str(tmp_path / "j"))) == values(df)
    assert values(files.round_trip(df, "csv", str(tmp_path / "c")))[0] == (1, "'=cmd")
    files.exclusive(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.exclusive(df, str(tmp_path / "once"))
    assert values(files.replace_partitions(df, "k", str(tmp_path / "p"))) == values(df)
    (tmp_path / "a.txt").write_text("hello")
    assert files.read_files(spark, str(tmp_path / "a.txt")).first().extension == "txt"


def test_rerun_with_other_partitions_gives_the_same_rows(spark, sf):
    from docweft.plans import registry

    first = values(registry.queries()["hybrid_rrf"](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert values(registry.queries()["hybrid_rrf"](spark, sf)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_document_parsers(spark):
    from docweft.sources import documents as D

    data = D.write_docx([("Heading1", "Top"), ("Normal", "Body & <text>"), ("ListBullet", "one"), ("ListBullet", "two"), ("Heading3", "Deep"), ("Heading2", "Next")])
    assert [x[1:] for x in D.parse_docx(data)] == [("heading", "Top", 1, "Top"), ("paragraph", "Body & <text>", None, "Top"), ("list", "one\ntwo", None, "Top"), ("heading", "Deep", 3, "Top > Deep"), ("heading", "Next", 2, "Top > Next")]
    assert [x[1:3] for x in D.parse_txt("﻿# A\n\nsome\ntext\n \n## B".encode())] == [("heading", "A"), ("paragraph", "some\ntext"), ("heading", "B")]
    files_ = spark.createDataFrame([(1, "docx", bytearray(data)), (2, "pdf", bytearray(b"%PDF-1")), (3, "docx", bytearray(b"x")), (4, "txt", bytearray(b"hi"))], "file_id long, extension string, content binary")
    rows = {(r.file_id, r.kind, r.problem) for r in D.extract(files_).collect()}
    assert {(2, None, "no parser"), (3, None, "no zip archive"), (4, "paragraph", None), (1, "list", None)} <= rows
