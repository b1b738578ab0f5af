"""Answers as plans: thresholds, order of passages, points and repair, stated by hand."""

from pyspark.sql import functions as F

from docweft.operators import service, spans

CALIBRATION = "The sensor array is recalibrated every 90 days. The lidar array requires calibration every 30 days. The power rail operates at 12 volts."


def test_rag_answer_thresholds(spark):
    q = spark.createDataFrame([(i, "lidar interval") for i in range(1, 7)], "question_id long, question string")
    chunks = [(1, 10, 5, 1, 0.9, "The lidar interval: thirty days."), (1, 11, 5, 2, 0.4, "x" * 3990), (1, 12, 6, 3, 0.3, "more"), (2, 10, 5, 1, 0.1, "The lidar interval: thirty days."), (3, 10, 5, 1, 0.6, "  "), (4, 10, 5, 1, 0.4, "Other text."), (5, 10, 5, 1, 0.8, "y" * 4001)]
    seen = []

    def reader(frame):
        seen.append(sorted(r.question_id for r in frame.collect()))
        return spans.novel_span(frame)

    r = spark.createDataFrame(chunks, "question_id long, chunk_id long, document_id long, rank long, score double, content string")
    got = {x.question_id: x for x in service.rag_answer(q, r, reader).collect()}
    assert seen == [[1, 4]]
    assert (got[1].answer, got[1].insufficient, got[1].grounded, got[1].sources, got[1].documents, got[1].mean_score) == ("thirty days", False, True, 3, 2, 0.5333)
    assert (got[2].answer, got[2].confidence, got[2].insufficient) == ("", 0.1, True)
    assert [got[i].insufficient for i in (3, 4, 5, 6)] == [True] * 4 and got[6].sources == 0 and got[4].confidence == 0


def test_qa_rerank_keeps_every_passage(spark):
    rows = [(1, "lidar", i, i, "lidar here" if i in (2, 9) else "other") for i in range(1, 11)] + [(1, "lidar", 11, 0, " ")]
    c = spark.createDataFrame(rows, "question_id long, question string, chunk_id long, rank long, content string")
    got = [r.chunk_id for r in service.qa_rerank(c, spans.novel_span).orderBy("place").collect()]
    assert got == [2, 1, 3, 4, 5, 6, 7, 11, 8, 9, 10]


def test_support_points_by_marks(spark):
    q = spark.createDataFrame([(1, "How is the lidar array calibrated?", "every 30 days", 15), (2, "How is the lidar array calibrated?", "", 5), (3, "How is the lidar array calibrated?", "", 10)], "question_id long, question string, answer string, marks int")
    text = CALIBRATION + " The lidar array is an important part. The lidar array is one important part. A lidar | B | C d e. Array calibration needs tools and time. Nothing of it said here."
    b = spark.createDataFrame([(i, 1, text) for i in (1, 2, 3)] + [(3, 2, "Lidar array calibration blocks dispatch. Short lidar.")], "question_id long, block int, content string")
    got = {}
    for r in service.support_points(q, b).orderBy("question_id", "place").collect():
        got.setdefault(r.question_id, []).append((r.block, r.sentence))
    assert got == {
        1: [(1, "The lidar array is an important part."), (1, "Array calibration needs tools and time.")],
        3: [(1, "The lidar array requires calibration every 30 days."), (1, "The lidar array is an important part."), (2, "Lidar array calibration blocks dispatch.")],
    }


def test_repair_keeps_supported_claims_with_sources(spark):
    said = {1: ["The lidar array requires calibration every 30 days.", "Cats fly high!"], 2: ["The power rail operates at 12 volts."], 3: ["Cats fly high."], 4: ["The power rail operates at 12 volts [1]!", "The rail is blue"]}
    rows = [(a * 10 + k, a, k, text, None, []) for a, claims in said.items() for k, text in enumerate(claims)]
    c = spark.createDataFrame(rows, "claim_id long, answer_id long, place int, claim string, question string, stated array<int>")
    b = spark.createDataFrame([(a, 1, CALIBRATION) for a in said] + [(1, 2, "Unrelated prose.")], "answer_id long, block int, content string")
    got = {r.answer_id: (r.answer, r.claims, r.kept, r.repaired) for r in service.retain_supported(c, b).collect()}
    assert got == {
        1: ("The lidar array requires calibration every 30 days [1].", 2, 1, True), 2: (said[2][0], 1, 1, False), 3: (said[3][0], 1, 0, False), 4: ("The power rail operates at 12 volts [1]!", 2, 1, True),
    }
    assert service.retain_supported(c.where(F.lit(False)), b).count() == 0


def test_evidence_follows_its_route(spark):
    q = [(1, "graph", "available"), (2, "semantic", "available"), (3, None, "available"), (4, "graph", "pending"), (5, "graph", None)]
    questions = spark.createDataFrame(q, "question_id long, route string, graph_state string")
    stream = lambda ids: spark.createDataFrame([(i, x, k + 1) for i, *_ in q for k, x in enumerate(ids)], "question_id long, chunk_id long, rank long")
    dense, lexical, structure, graph = stream([1, 2]), stream([2, 3]), stream([3]), stream([9, 1])

    def found(**more):
        out = {}
        for r in service.retrieve_evidence(questions, dense, lexical, structure, graph, **more).orderBy("place").collect():
            out.setdefault((r.question_id, r.path), []).append(r.chunk_id)
        return out

    text = [3, 2, 1]
    assert found() == {(1, "graph"): [9, 1], (2, "semantic"): text, (3, "both"): [1, 3, 9, 2], (4, "semantic"): text, (5, "semantic"): text}
    last = found(top_k=1, rerank=lambda pool: pool.withColumn("rank", -F.col("chunk_id")))
    assert last == {(1, "graph"): [9], (2, "semantic"): [3], (3, "both"): [9], (4, "semantic"): [3], (5, "semantic"): [3]}


def test_document_evidence_has_headings_and_does_not_leak(spark):
    elements = spark.createDataFrame([(1, "a", None, "A"), (1, "b", "a", "B"), (1, "c", "b", "C"), (1, "d", "c", "D"), (1, "e", "d", "E"), (2, "x", "a", "X")], "document_id long, element_id string, parent_id string, heading string")
    asked = spark.createDataFrame([(1, 1, "e", 1), (1, 1, "x", 2), (1, 1, "b", 3), (1, 1, "a", 4), (1, 1, "gone", 5), (2, 2, "x", 1)], "question_id long, document_id long, element_id string, rank long")
    semantic = spark.createDataFrame([(1, str(k), k) for k in range(10)], "question_id long, id string, rank long")
    got = {}
    for r in service.fuse_document_evidence(asked, semantic, elements).orderBy("place").collect():
        got.setdefault(r.question_id, []).append((r.id, r.context))
    assert got == {1: [(str(k), None) for k in range(8)] + [("e", "B > C > D"), ("b", "A"), ("a", None)], 2: [("x", "A")]}
