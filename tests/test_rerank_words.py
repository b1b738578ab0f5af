"""Reranking cuts only the documents that it needs into words."""

import pytest
from pyspark.sql import functions as F

from docweft.plans import q_evidence


def test_other_documents_are_not_read(spark):
    dense = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 9, 0.7, 3)], "question_id long, chunk_id long, score double, rank long")
    fails = F.when(F.col("doc_id") == 5, F.raise_error(F.lit("read")).cast("string")).otherwise(F.col("text"))
    documents = spark.createDataFrame([(0, "Red fox red"), (1, "fox"), (2, "the red FOX"), (5, "x"), (3, None)], "doc_id long, text string")
    got = {(r.chunk_id, r.place) for r in q_evidence._reranked(dense, documents.select("doc_id", fails.alias("text"))).collect()}
    assert got == {(2, 1), (1, 2), (9, 3)}
    with pytest.raises(Exception, match="read"):
        documents.select(fails.alias("text")).collect()
