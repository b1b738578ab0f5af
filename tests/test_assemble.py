"""Assembled evidence, lists, fallback sentences, prompts, snapshots and batches on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from docweft.operators import assemble as A


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_topic_keeps_the_seed_beyond_the_cap(spark):
    df = spark.createDataFrame([(9, 1, 0, 5), (9, 2, 1, 6), (9, 9, 2, 50)], "seed long, chunk_id long, place long, bytes int")
    assert rows(A.topic(df, 55), "chunk_id", "complete") == [(1, False), (9, False)]
    assert rows(A.topic(df, 10), "chunk_id", "complete") == [(9, False)]
    assert rows(A.topic(df, 61), "chunk_id", "complete") == [(1, True), (2, True), (9, True)]


def test_lists_need_a_heading_and_two_items_and_answers_one_list(spark):
    text = ["red apples list", "one", "two", "", "alone", "single", "  ", "blue pears list", "three", "four", "five"]
    lines = spark.createDataFrame([(1, 100 + i, i, t) for i, t in enumerate(text)], "document_id long, chunk_id long, chunk_index long, content string")
    found = A.lists(lines)
    assert rows(found, "item", "content") == [(1, "one"), (1, "three"), (2, "four"), (2, "two"), (3, "five")]
    asked = spark.createDataFrame([(1, ["red", "apples"], 2), (2, ["blue", "pears", "list"], 3), (3, ["red"], 1), (4, ["apples", "red", "list", "pears"], 1)], "question_id long, tokens array<string>, position long")
    # the last question meets both lists, so it has no answer
    assert rows(A.list_answer(asked, found), "question_id", "chunk_id") == [(1, 102), (2, 110)]


def test_list_answers_meet_few_lists_first(spark, monkeypatch):
    """Two lists settle a question, in whichever round it meets them; those met once or never go on to all lists."""
    monkeypatch.setattr(A, "FIRST_HEADS", 2)
    monkeypatch.setattr(A, "MORE", 3)
    heads = [[f"w{i}", f"x{i}"] + ["frequent", "words"] * (i % 3 == 0) for i in range(60)]
    items = spark.createDataFrame([(d, 0, k, 100 * d + k, " ".join(h) if k == 1 else None) for d, h in enumerate(heads) for k in (1, 2)], "document_id long, list long, item long, chunk_id long, heading string")
    tokens = [[f"w{i}", f"x{i}"] + ["frequent", "words"] * (i % 4 == 0) for i in range(80)]
    asked = spark.createDataFrame([(q, t, q % 2 + 1) for q, t in enumerate(tokens)], "question_id long, tokens array<string>, position long")
    want = []
    for q, t in enumerate(tokens):
        met = [d for d, h in enumerate(heads) if len(set(h) & set(t)) >= 2]
        want += [(q, 100 * met[0] + q % 2 + 1)] if len(met) == 1 else []
    assert rows(A.list_answer(asked, items), "question_id", "chunk_id") == want and len(want) == 45


def test_fallback_orders_by_shared_names_and_counts_equal_sentences_once(spark):
    good = "Later the old bridge of Norwich was rebuilt in stone by its town."
    text = f"Too short here. Some long sentence about nothing of any interest at all! {good} {good} This long sentence only carries the copyright of the book."
    df = spark.createDataFrame([(1, "When was Norwich bridged?", text, 4), (2, None, None, 2)], "question_id long, question string, evidence string, most int")
    out = A.fallback(df).orderBy("question_id", "place").collect()
    assert [(r.sentence, r.overlap) for r in out] == [(good, 1), ("Some long sentence about nothing of any interest at all!", 0)]


def test_prompt_numbers_evidence_below_its_groups(spark):
    df = spark.createDataFrame([(1, "q?", "b", 2, "y"), (1, "q?", "a", 1, "x"), (1, "q?", "a", 3, "z")], "question_id long, question string, grouping string, rank long, text string")
    assert A.prompt(df).first().prompt == "Question: q?\n## a\n[1] x\n[3] z\n## b\n[2] y"


def test_archive_keeps_nulls_and_refuses_nan(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 0, 2.5), (1, 1000, 1.0)], "document_id long, i long, v double")
    assert rows(A.archive(df, "document_id", "i", ["i", "v"]), "part", "payload") == [(0, '[{"i":0,"v":2.5},{"i":1,"v":null}]'), (1, '[{"i":1000,"v":1.0}]')]
    with pytest.raises(Exception, match="NaN in v"):
        A.archive(df.withColumn("v", F.lit(float("nan"))), "document_id", "i", ["i", "v"]).collect()


def test_batches_resume_behind_the_cursor_and_restart_on_another_fingerprint(spark):
    items = spark.createDataFrame([(d, i, "f") for d in (1, 2, 3) for i in range(5)], "document_id long, place long, fingerprint string")
    cursor = spark.createDataFrame([(1, "f", 1), (2, "old", 1)], "document_id long, fingerprint string, last long")
    batch = A.next_batch(items, cursor, 2)
    assert rows(batch, "document_id", "place") == [(1, 2), (1, 3), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert rows(A.cursor_after(batch), "document_id", "last") == [(1, 3), (2, 1), (3, 1)]


def test_elements_skip_blanks_and_structure_takes_best_documents(spark):
    reached = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "c", 2)], "root string, id string, depth int")
    texts = spark.createDataFrame([("a", " "), ("b", "x"), ("c", "y")], "id string, text string")
    assert rows(A.element_candidates(reached, texts, 1), "id") == [("b",)]
    hits = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (1, 7, 3)], "question_id long, document_id long, rank long")
    elements = spark.createDataFrame([(7, 70, 0), (8, 81, 1), (8, 80, 0)], "document_id long, element_id long, seq long")
    assert rows(A.structure_evidence(hits, elements, 1, 1), "document_id", "element_id", "place") == [(8, 80, 1)]
