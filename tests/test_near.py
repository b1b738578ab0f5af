"""Near pairs equal a comparison of all pairs."""

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from docweft.operators import near
from docweft.plans import registry
from docweft.session import table


def plain(texts, least=0.85):
    first = {}
    for i, q in sorted(texts, key=lambda x: x[0]):
        if q:
            first.setdefault(q.lower(), i)
    rows = sorted((i, q) for q, i in first.items())
    out = {}
    for x, (i, p) in enumerate(rows):
        for j, q in rows[x + 1 :]:
            ratio = SequenceMatcher(None, p, q).ratio()
            if least <= ratio < 1:
                out[i, j] = (round(ratio, 3), "DUPLICATE_PATTERN" if ratio >= 0.95 else "LEGITIMATE_VARIATION")
    return out


def test_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = ["what is the employees for 2010?", "how much is the revenue of the north division", "list all steps", "aaaa aaaa aaaa", "ab"]
    texts = [(i, "".join(c for c in str(rng.choice(base)) if rng.random() > 0.06) + str(rng.choice(["", "?", " x", "Ü"]))) for i in range(160)] + [(500, None), (501, ""), (502, "List ALL steps"), (503, "x"), (504, "y")]
    frame = spark.createDataFrame(texts, "id long, q string")
    for least in (0.85, 0.6):
        got = {(r.a, r.b): (r.ratio, r.kind) for r in near.near_pairs(frame, least).collect()}
        assert got == plain(texts, least) and got
    assert near.near_pairs(spark.createDataFrame([], "id long, q string")).count() == 0


def test_query_equals_all_pairs(spark, sf):
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    got = {(r.a, r.b): (r.ratio, r.kind) for r in registry.queries()["near_dups"](spark, sf).collect()}
    assert got == plain(items)


def test_candidates_are_fewer_than_pairs(spark, sf):
    frame = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("q"))
    n = frame.count()
    assert near.candidates(frame, 0.85).count() < n * (n - 1) / 2
