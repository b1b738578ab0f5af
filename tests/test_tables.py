"""Tables in evidence, numeric alignment and the entity graph: decisions stated by hand."""

import pytest
from pyspark.sql import functions as F

from docweft.operators import alignment, graph, tables

RATES = "Tier | Rate Limit | Burst Limit | Monthly Quota\nPremium | 1,000 req/min | 1,500 req/min | 5,000,000 requests\nStandard | 100 req/min | 150 req/min | 500,000 requests"
YEARS = "Year | Revenue (USD) | Employees\n2010 | $178.0M | 650\n2015 | $290.1M | 900"
WEATHER = "Variable | Unit | Min | Max | Mean | Missing %\nWind Speed | m/s | 0.0 | 58.4 | 4.2 | 0.2%\nPressure | hPa | 954.2 | 1083.8 | 1013.2 | 0.1%"
DIVISIONS = "Division | Q3 2025 Revenue | Q3 2024 Revenue | YoY Growth\nProfessional Services | $147.7M | $141.8M | +4.2%\nEnterprise Solutions | $412.5M | $348.7M | +18.3%\nOther | $0.0M | $1.6M | -100.0%"
ANSWERS = [
    ("What is the employees for 2010?", [YEARS], ("cell", "650", "Employees", 1)),
    ("According to the table, what is the revenue (usd) for 2010?", [YEARS], ("cell", "$178.0M", "Revenue (USD)", 1)),
    ("What are all the values for Pressure?", [WEATHER], ("row", "Pressure | hPa | 954.2 | 1083.8 | 1013.2 | 0.1%", None, 1)),
    ("What information is recorded for Premium?", [RATES], ("row", "Premium | 1,000 req/min | 1,500 req/min | 5,000,000 requests", None, 1)),
    ("Looking at the table, what division value does Other show?", [DIVISIONS], ("cell", "Other", "Division", 1)),
    ("How much is the monthly quota of Standard?", [RATES], ("cell", "500,000 requests", "Monthly Quota", 1)),
    ("What is Premium's rate limit?", ["Unrelated prose.", RATES], ("cell", "1,000 req/min", "Rate Limit", 2)),
    ("What is the employees for 1999?", [YEARS], None),
    ("Where is the Premium tier described?", [RATES], None),
    ("What is the value for Widget?", ["Name | Value A | Value B\nWidget | 1 | 2"], None),
    ("What is the limit of Premium?", ["prose | with\nbars"], None),
    ("What is the rate of K?", ["T | Rate | X\nK | 1 | 2\nnote\nT | Rate | X\nK | 3 | 4"], ("cell", "1", "Rate", 1)),
    (None, [RATES], None),
]


def test_answers(spark):
    q = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "question_id long, question string")
    blocks = [(i * 10 + k, i, k + 1, text) for i, a in enumerate(ANSWERS) for k, text in enumerate(a[1])]
    b = spark.createDataFrame([(x[0], x[3]) for x in blocks], "block_id long, content string")
    e = spark.createDataFrame([(x[1], x[2], x[0]) for x in blocks], "question_id long, place long, block_id long")
    got = {r.question_id: (r.kind, r.text, r.column, r.block_id % 10 + 1) for r in tables.answer(q, e, tables.parse(b)).collect()}
    assert got == {i: a[2] for i, a in enumerate(ANSWERS) if a[2]}


def test_parse_breaks_tables(spark):
    text = "A | B | C\n1 | 2 | 3\n4 | 5\n| X | Y | Z | W |\r\n| 1 | 2 | 3 | 4 |\nA | B | C\n\nT | U | V\n1 | 2 | 3"
    rows = tables.parse(spark.createDataFrame([(1, text), (2, None)], "block_id long, content string")).orderBy("tbl", "row").collect()
    assert [(r.tbl, r.row, r.cells[0]) for r in rows] == [(1, 0, "A"), (1, 1, "1"), (2, 0, "X"), (2, 1, "1"), (4, 0, "T"), (4, 1, "1")]


def test_row_evidence_gate(spark):
    head = ["Part", "Service Interval", "Wear Limit"]
    body = [(1, ["Pump A", "250 h", "2.5 mm"]), (2, ["Pump B", "400 h", "3.0 mm"]), (3, ["Valve " + "long " * 80, "250 h pump", "1 mm"])]
    rows = [("d", "t", 0, True, head, " | ".join(head))] + [("d", "t", i, False, x, " | ".join(x)) for i, x in body] + [("d", "u", 0, True, head, "x"), ("d", "u", 1, False, ["Pump A", "9 h", "1"], "Pump A"), ("d", "v", 1, False, ["Pump A", "9 h", "1"], "Pump A")]
    r = spark.createDataFrame(rows, "document_id string, table_id string, row_index long, is_header boolean, cells array<string>, content string")
    q = [(1, "What service interval does the manual give for pump A?"), (2, "Which power rail supplies the pump controller servo unit?"), (3, "service interval of the 250 cases"), (4, "")]
    got = tables.row_evidence(spark.createDataFrame([(*x, "d") for x in q], "question_id long, question string, document_id string"), r)
    assert sorted((x.question_id, x.place, x.table_id, x.row_index, x.label_matches > 0) for x in got.collect()) == [(1, 1, "t", 1, True), (1, 2, "t", 2, True), (3, 1, "t", 1, False)]


CALIBRATION = "The sensor array is recalibrated every 90 days. The lidar array requires\ncalibration every 30 days. The power rail operates at 12 volts."
LIDAR = "How often is the lidar array recalibrated?"
ALIGNED = [
    (LIDAR, "every 30 days", CALIBRATION, "matched"), (LIDAR, "every 90 days", CALIBRATION, "mismatch"), (LIDAR, "The lidar array needs calibration", CALIBRATION, "not_applicable"), (LIDAR, "every 45 days", CALIBRATION, "unable"),
    ("How often is the sensor array recalibrated?", "every 90 days", CALIBRATION, "matched"), ("What is Premium's rate limit?", "1,000 req/min", RATES, "matched"), ("How much is the monthly quota of Standard?", "500,000 requests", RATES, "matched"),
    ("What yoy growth does Professional Services have?", "+4.2%", DIVISIONS, "matched"), ("What is the mean for Wind Speed?", "0.0", WEATHER, "mismatch"), ("What is Premium's rate limit?", "100 req/min", RATES, "mismatch"),
    ("How much is the q3 2025 revenue of Other?", "$0.0M and $1.6M", DIVISIONS, "mismatch"), ("Who is in the current leadership?", "COO: Elena Vasquez (since June 2021)", "Current Leadership\nCEO: Sarah Chen (since 2022)\nCOO: Elena Vasquez (since June 2021)\n\nOther text 5.", "matched"),
    (LIDAR, "30", "One sentence of 30.", "not_applicable"), (None, "30", CALIBRATION, "not_applicable"), (LIDAR, None, CALIBRATION, "not_applicable"), (LIDAR, "30", None, "not_applicable"),
]


def test_alignment(spark):
    frame = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(ALIGNED)], "i long, question string, claim string, evidence string")
    got = {r.i: r.alignment for r in alignment.align(frame).collect()}
    assert got == {i: a[3] for i, a in enumerate(ALIGNED)}


def test_long_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(1000)] + [(1000, None), (2001, 2002), (2002, 2003), (2003, 2001), (2004, 2001), (3000, 3000), (None, 5)]
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(spark.createDataFrame(links, "id long, parent_id long")).where("node >= 1999 OR node % 97 = 0").collect()}
    want = {(i, j): j - i for i in range(0, 1001, 97) for j in range(i + 1, 1001)}
    want |= {(2001, 2002): 1, (2001, 2003): 2, (2002, 2003): 1, (2002, 2001): 2, (2003, 2001): 1, (2003, 2002): 2, (2004, 2001): 1, (2004, 2002): 2, (2004, 2003): 3}
    assert got == want
    assert graph.closure(spark.createDataFrame([], "id long, parent_id long")).count() == 0


def test_walk_keeps_paths_and_checks_quotes(spark):
    e = [("u", "1", "Sensor Array"), ("u", "2", "Lidar"), ("u", "3", "Rail"), ("u", "4", "Fuse"), ("w", "9", "Lidar")]
    entities = spark.createDataFrame(e, "owner string, entity_id string, name string")
    facts = [(1, "1", "2", "feeds", "Sensor Array feeds Lidar"), (2, "3", "2", "powers", "Rail powers Lidar"), (3, "3", "4", "has", "not in the text"), (4, "4", "4", "trips", "Fuse trips")]
    relations = spark.createDataFrame([("u", i, p, 7, i, i * 2, i * 2 + 1, q) for i, _, _, p, q in facts] + [("w", 9, "x", 8, 9, 18, 19, "q")], "owner string, rid long, predicate string, document_id long, chunk_id long, subject_mention long, object_mention long, quote string")
    ends = [(i * 2 + k, x[k + 1], "u", 7, i) for i, x in enumerate(facts, 1) for k in (0, 1)] + [(18, "9", "u", 8, 9), (19, "9", "w", 8, 9)]
    mentions = spark.createDataFrame(ends, "mention_id long, entity_id string, owner string, document_id long, chunk_id long")
    chunks = spark.createDataFrame([(i, 7, "Sensor Array feeds Lidar. Rail powers Lidar. Fuse trips.") for i in (1, 2, 3, 4)], "chunk_id long, document_id long, content string")
    rows = graph.relation_rows(relations, mentions, entities, chunks, spark.createDataFrame([(7, "u"), (8, "w")], "document_id long, owner string"))
    assert sorted(r.rid for r in rows.collect()) == [1, 2, 3, 4]
    seeds = graph.entity_seeds(spark.createDataFrame([(1, "u", "What does the sensor array feed?"), (2, "w", "lidar")], "question_id long, owner string, question string"), entities)
    assert sorted((r.question_id, r.entity_id) for r in seeds.collect()) == [(1, "1"), (2, "9")]
    got = sorted((r.question_id, r.chunk_id, r.hops, r.path, r.place) for r in graph.walk_relations(seeds, rows).collect())
    assert got == [(1, 1, 1, "Sensor Array feeds Lidar", 1), (1, 2, 2, "Sensor Array feeds Lidar ← powers Rail", 2)]
    assert graph.walk_relations(seeds, rows, hops=1).count() == 1


@pytest.mark.parametrize("text,want", [("Dr. Who is 5 m.", ["dr."]), ("12 volts rail here", ["12", "volts"]), ("", [])])
def test_subject(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(alignment.subject(F.col("t")).alias("s")).first().s == want


def test_parsed_relations_are_quoted_literally(spark):
    import json

    item = lambda s, p, o, q: {"subject": s, "predicate": p, "object": o, "quote": q}
    chunk = "so a p b, and c q d. Long " + "x" * 500
    cases = [
        (json.dumps([item("a", "p", "b", "a p b"), item("a", "p", "a", "a p a"), item(" a ", "p", "b", "so a p b")]), [("a", "p", "b")]),
        (json.dumps([item("c", "q", "d", "c q d"), item("c", "q", "e", "c q d"), item("c", "q", "d", "unsaid c q d"), item("", "q", "d", "c q d"), item("C", "q", "c", "c q d"), item("a", "p", "b", "a p b, and c q d"), {}]), [("c", "q", "d"), ("a", "p", "b")]),
        (json.dumps([item("a", k, "b", "a p b") for k in "12345"]), [("a", "1", "b"), ("a", "2", "b"), ("a", "3", "b")]),
        (json.dumps([item("x", "p", "Long", "Long " + "x" * 500)]), []), ("no list", []), ("", []), (None, []), ("[1, null]", []),
    ]
    frame = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i long, raw string").withColumn("r", graph.parse_relations(F.col("raw"), F.lit(chunk)))
    assert {r.i: [(x.subject, x.predicate, x.object) for x in r.r] for r in frame.collect()} == {i: want for i, (_, want) in enumerate(cases)}
