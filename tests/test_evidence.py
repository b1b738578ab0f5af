"""Claims, scores and containment on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from docweft.operators import claims as K
from docweft.operators import scoring as S


def frames(spark):
    kind = "tokens array<string>, numbers array<string>"
    claims = spark.createDataFrame(
        [(1, ["valve", "opens", "warm", "rare", "pump"], [], [10]), (2, ["valve", "opens"], ["7"], [11]), (3, ["zebra"], [], []), (4, [], [], []), (5, ["valve", "pump", "x1", "x2"], ["9"], [])],
        f"claim_id long, {kind}, stated array<bigint>",
    )
    blocks = spark.createDataFrame(
        [(10, ["valve", "opens", "other"], []), (11, ["valve", "opens", "warm"], ["7", "8"]), (12, ["valve", "pump", "x1"], ["9"]), (13, ["opens"], ["7"]), (14, [], [])], f"block_id long, {kind}"
    )
    return claims, blocks


def test_claims_meet_the_blocks_that_support_them(spark):
    claims, blocks = frames(spark)
    want = set()
    for q in claims.collect():
        for b in blocks.collect():
            share = len(set(q.tokens) & set(b.tokens)) / len(q.tokens) if q.tokens else 0
            if share >= (0.45 if q.numbers else 0.6) and set(q.numbers) <= set(b.numbers):
                want.add((q.claim_id, b.block_id))
    got = K.attribute(claims, blocks)
    assert {(r.claim_id, r.block_id) for r in got.collect()} == want == {(1, 11), (2, 11), (2, 13), (5, 12)}
    states = {r.claim_id: r.state for r in K.check(claims, got).collect()}
    assert states == {1: "MISCITED", 2: "SUPPORTED", 3: "UNSUPPORTED", 4: "UNSUPPORTED", 5: "SUPPORTED"}
    verdicts = {r.answer_id: (r.verdict, r.citation_accuracy) for r in K.verify(K.check(claims, got), F.floor(F.col("claim_id") / 3)).collect()}
    assert verdicts == {0: ("VERIFIED", 0.5), 1: ("PARTIAL", pytest.approx(1 / 3, abs=1e-6))}


def test_containment_finds_short_long_and_inner_items(spark):
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, "xalpha beta gamma delta epsilonx"), (3, "tiny"), (4, ""), (5, None), (6, "beta gamma delta")]
    items = [(1, "alpha beta gamma delta epsilon"), (2, "pha beta gamma delta eps"), (3, "tiny"), (4, "gamma delta"), (5, ""), (6, None), (7, "alpha  beta gamma delta epsilon")]
    got = S.contained(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(items, "item_id long, item string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, i) for t, x in texts for i, y in items if x is not None and y is not None and y in x)


def test_scores_of_extraction(spark):
    df = spark.createDataFrame([(["b c", "a", "z"], "A  b C then a", [["h ", "x"], ["1"]], [["H", "X", "q"]]), ([], "any", [], [])], "pieces array<string>, text string, e array<array<string>>, a array<array<string>>")
    rows = df.select(S.kept_share(F.col("pieces"), F.col("text")).alias("kept"), S.ordered_share("pieces", "text").alias("order"), *S.table_match(F.col("e"), F.col("a"))).collect()
    assert rows[0].kept == pytest.approx(2 / 3) and rows[0].order == pytest.approx(1 / 3) and (rows[0].row_score, rows[0].column_score, rows[0].header) == (0.5, 1.0, False)
    assert rows[1].kept == rows[1].order == rows[1].row_score == 1.0


def test_ratings_need_two_raters_and_count_repeats(spark):
    reviews = spark.createDataFrame([("A", 5, 1, "r", 5.0), ("A", 5, 1, "s", 0.0), ("A", 5, 2, "r", 4.0), ("A", 5, 2, "r", 2.0), ("A", 5, 3, "r", None)], "variant string, marks int, query_id long, reviewer string, score double")
    row = S.review_summary(reviews).first()
    assert (row.reviews, row.pending, row.duplicates, row.mean_score, row.fraction) == (5, 1, 1, 2.75, 0.55)
    assert [(r.questions, r.nhrs) for r in S.dual_rater(reviews).collect()] == [(1, 0.5)]


def test_units_need_all_spans_of_one_alternative(spark):
    units = spark.createDataFrame([(1, 0, 0, 7, 0, 10), (1, 0, 0, 7, 20, 30), (1, 0, 1, 8, 5, 6), (1, 1, 0, 7, 0, 10), (2, 0, 0, 7, 0, 1)], "question_id long, unit int, alternative int, document int, start int, end int")
    spans = spark.createDataFrame([(1, 7, 0, 15, 100), (1, 7, 12, 30, 100)], "question_id long, document int, lo int, hi int, tokens int")
    got = {r.question_id: (r.units, r.covered, r.rer, r.ect) for r in S.evidence_units(units, spans).collect()}
    assert got == {1: (2, 2, 1.0, 10.0), 2: (1, 0, 0.0, None)}


def test_reranking_is_stable_and_keeps_unscored_ones_last(spark):
    df = spark.createDataFrame([(1, i, i, s) for i, s in enumerate([0.1, 0.9, None, 0.9])] + [(1, 0, 9, 5.0)], "question_id long, chunk_id long, rank long, s double")
    assert [r.chunk_id for r in S.rerank(df, F.col("s")).orderBy("place").collect()] == [1, 3, 0, 2]
