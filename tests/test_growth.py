"""Steps whose memory or rows grew faster than the input: ranks from distinct values, bounds of full text, bounded Python batches."""

from pyspark.sql import functions as F

from docweft.operators import chunking, fulltext, statistics
from docweft.sources import documents


def test_ranks_come_from_distinct_values(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 4.0, 1.0), ("b", None, 1.0), ("b", 2.0, 1.0), (None, 5.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "g string, x double, y double")
    assert statistics.value_ranks(df, "x", ["g"]).count() == 5
    got = {(r.g, r.x, r.avg_rank) for r in statistics.with_average_rank(df, "x", ["g"]).collect()}
    want = {(r.g, r.x, r.w) for r in df.withColumn("w", statistics.average_rank("x", ["g"])).collect()}
    assert got == want
    plain = df.select("g", statistics.average_rank("x", ["g"]).alias("a"), statistics.average_rank("y", ["g"]).alias("b")).where("g = 'a'").agg(F.corr("a", "b")).first()[0]
    assert abs({r.g: r.rho for r in statistics.spearman(df, "x", "y", ["g"]).collect()}["a"] - plain) < 1e-12


def test_bounds_are_not_below_densities(spark):
    texts = [" ".join("red blue green stone"[(i * j) % 17 :: 1 + (i + j) % 3].split() * (1 + j % 3)) + " red" * (i % 5) + " blue red" * (i % 4) for i in range(40) for j in (2, 5)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = fulltext.units(spark.createDataFrame([(1, "red blue"), (2, '"blue red" or stone'), (3, "red -green")], "question_id long, question string"))
    index = fulltext.positions(chunks)
    counts = index.groupBy("lexeme", "chunk_id").agg(F.count("*").alias("tf"))
    pairs = fulltext.candidates(asked, index).select("question_id", "chunk_id").distinct()
    bound = {(r.question_id, r.chunk_id): r.bound for r in fulltext.bounds(asked, pairs, counts).collect()}
    exact = fulltext.ranked(asked, pairs, index).collect()
    assert exact and all(bound[r.question_id, r.chunk_id] >= r.score for r in exact)
    for k in (3,):
        want = {}
        for r in sorted(exact, key=lambda r: (-r.score, r.chunk_id)):
            want.setdefault(r.question_id, []).append(r.chunk_id)
        got = {}
        for r in fulltext.search(None, index, k, asked).orderBy("rank").collect():
            got.setdefault(r.question_id, []).append(r.chunk_id)
        assert got == {q: ids[:k] for q, ids in want.items()}


def test_python_hands_on_bounded_batches(spark):
    assert documents.YIELDED <= 4096 and chunking.YIELDED <= 4096
    data = documents.write_docx([("Normal", f"line {i}") for i in range(3000)])
    files = spark.createDataFrame([(i, "docx", data) for i in range(4)], "file_id long, extension string, content binary").coalesce(1)
    assert documents.extract(files).count() == 12000
