"""Covered evidence units without pairs of units and spans: alternatives, gaps between spans, missing values; a task's rows are bounded."""

from docweft.operators import scoring


def test_units_against_plain_reading(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TASK_UNITS", 2, raising=False)
    units = [(1, 0, 0, 0, 5, 9), (1, 0, 0, 1, 5, 9), (1, 0, 1, 0, 3, 4), (1, 1, 0, 0, 0, 50), (1, 2, 0, None, 1, 2), (2, 0, 0, 0, 7, None), (2, 1, 0, 0, 8, 8), (3, 0, 0, 0, 1, 2), (None, 0, 0, 0, 5, 6)] + [(q, q % 3, q % 2, 0, q % 9, q % 9 + 3) for q in range(4, 60)]
    spans = [(1, 0, 0, 4, 10.0), (1, 0, 2, 9, 5.0), (1, 1, 6, 20, 1.0), (1, 0, 5, 8, None), (1, None, 0, 99, 2.0), (2, 0, 8, 8, 4.0), (2, 0, None, 90, 4.0), (2, 0, 0, None, 4.0), (None, 0, 0, 99, 1.0)] + [(q, 0, q % 4, q % 11, 1.0) for q in range(4, 60)]
    df = spark.createDataFrame(units, "question_id long, unit int, alternative int, document long, start long, end long")
    sf = spark.createDataFrame(spans, "question_id long, document long, lo long, hi long, tokens double")
    got = {r.question_id: (r.units, r.covered) for r in scoring.evidence_units(df, sf).collect()}
    inside = lambda u: any(None not in (u[0], u[3], s[1], *u[4:], *s[2:4]) and s[:2] == (u[0], u[3]) and s[2] <= u[4] and u[5] <= s[3] for s in spans)
    want = {}
    for q in {u[0] for u in units}:
        own = [u for u in units if u[0] == q]
        whole = [any(all(inside(u) for u in own if u[1:3] == (n, alt)) for alt in {u[2] for u in own if u[1] == n}) for n in {u[1] for u in own}]
        want[q] = (len(whole), sum(whole))
    assert got == want
    assert 0 < sum(c for _, c in want.values()) < sum(n for n, _ in want.values())


def test_units_meet_no_spans_in_pairs(spark):
    units = spark.range(3000).selectExpr("1L AS question_id", "id AS unit", "0 AS alternative", "0 AS document", "id AS start", "id + 1 AS end")
    spans = spark.range(3000).selectExpr("1L AS question_id", "0 AS document", "id AS lo", "id + 1 AS hi", "1D AS tokens")
    plan = scoring.evidence_units(units, spans)
    assert "[question_id" in plan._jdf.queryExecution().optimizedPlan().toString() and "lo#" not in "".join(x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert plan.first().covered == 3000
