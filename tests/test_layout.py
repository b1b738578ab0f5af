"""Reading order, captions, spans and variants: cases stated by hand, and a plain search over all spans."""

import numpy as np
from pyspark.sql import functions as F

from docweft.operators import layout, spans, variants

BOX = "page long, region_id string, x0 double, y0 double, x1 double, y1 double"


def order(spark, rows):
    got = layout.order_regions(spark.createDataFrame([(1, *r) for r in rows], BOX)).orderBy("place").collect()
    return [r.region_id for r in got]


def test_columns_and_bands(spark):
    two = [("l1", 0.1, 0.2, 0.45, 0.3), ("l2", 0.1, 0.4, 0.45, 0.5), ("r1", 0.55, 0.15, 0.9, 0.3), ("r2", 0.55, 0.4, 0.9, 0.5)]
    assert order(spark, two) == ["l1", "l2", "r1", "r2"]
    assert order(spark, [("head", 0.1, 0.35, 0.9, 0.38), *two]) == ["l1", "r1", "head", "l2", "r2"]
    assert order(spark, [("top", 0.1, 0.0, 0.9, 0.1), *two, ("end", 0.1, 0.9, 0.9, 1.0)]) == ["top", "l1", "l2", "r1", "r2", "end"]
    assert order(spark, two[:3]) == ["r1", "l1", "l2"]
    assert order(spark, [*two, ("over", 0.3, 0.6, 0.52, 0.7), ("across", 0.48, 0.1, 0.7, 0.2)]) == ["across", "r1", "l1", "l2", "r2", "over"]


def test_captions_take_the_nearest_above_or_below(spark):
    rows = [(1, "c", 0.1, 0.52, 0.9, 0.57, "caption"), (1, "f", 0.1, 0.1, 0.9, 0.5, "figure"), (1, "t", 0.2, 0.58, 0.8, 0.9, "table"), (1, "lone", 0.95, 0.52, 0.99, 0.55, "caption"), (2, "c2", 0.1, 0.52, 0.9, 0.57, "caption")]
    got = layout.caption_link(spark.createDataFrame(rows, BOX + ", kind string")).collect()
    assert [(r.region_id, r.figure) for r in got] == [("c", "t")]


def test_joint_span_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for q in range(30):
        s, e = rng.integers(-5, 6, 40) / 2, rng.integers(-5, 6, 40) / 2
        rows += [(q, i, f"t{i}", float(s[i]), float(e[i])) for i in range(40)]
        best = max(((s[i] + e[j], -i, -j) for i in range(40) for j in range(i, min(40, i + 4))))
        want[q] = (-best[1], -best[2], best[0], " ".join(f"t{i}" for i in range(-best[1], -best[2] + 1)))
    frame = spark.createDataFrame(rows, "question_id long, i long, token string, start double, end double")
    assert {r.question_id: (r.start_at, r.end_at, r.total, r.answer) for r in spans.joint_span(frame, 4).collect()} == want


def test_novel_span(spark):
    rows = [("What is the lidar interval?", "The rail is 12 volts. The lidar interval: every 30 days, or (sooner) if lidar fails badly now.", "every 30 days"), ("lidar", "Lidar!", "Lidar!"), ("lidar", "Nothing here.", ""), (None, "x", ""), ("x", None, ""), ("the of", "the of", "")]
    got = spans.novel_span(spark.createDataFrame(rows, "question string, evidence string, want string"))
    assert [r.answer for r in got.collect() if r.answer != r.want] == []


def test_variants_follow_their_options(spark):
    q = spark.createDataFrame([(1, 9, "pump pressure")], "question_id long, document_id long, question string")
    lines = [(9, 90, "Pumps", 0, None, "Intro"), (9, 91, "pump pressure is 5", 1, 90, "Pumps"), (9, 92, "other", 2, 90, "Pumps"), (9, 93, "pump", 3, 97, "Rail"), (9, 97, "Rail", 7, None, "Rail"), (8, 80, "pump pressure", 0, None, "x")]
    rows = spark.createDataFrame(lines, "document_id long, chunk_id long, content string, seq long, parent_id long, section string")
    elements = rows.select("document_id", F.col("chunk_id").alias("element_id"), "parent_id", "content", "seq", F.col("section").alias("heading"))
    rel = variants.relations(q, rows.withColumn("element_id", F.col("chunk_id")), elements)
    found = {}
    for r in variants.run([*variants.VARIANTS, {"variant": "E", "rank": "element", "keep_zero": False, "expand": "none", "top_k": 1}], rel).orderBy("place").collect():
        found.setdefault(r.variant, []).append((r.kind[0], r.id))
    assert found == {
        "A": [("c", 91), ("c", 93), ("c", 90), ("c", 92), ("c", 97)],
        "B": [("c", 91), ("c", 92), ("c", 93), ("c", 97)],
        "C": [("e", 91), ("e", 93), ("e", 90), ("e", 97)],
        "D": [("c", 91), ("c", 93), ("e", 91), ("e", 93)],
        "E": [("e", 91)],
    }
