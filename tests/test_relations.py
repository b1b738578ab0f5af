"""Claims against evidence sentences: single decisions stated by hand."""

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import relations as R

LIDAR = ["The sensor array is recalibrated every 90 days. The lidar array requires calibration every 30 days."]
LIDAR_ONE = ["The lidar array requires calibration every 30 days."]
WIND = ["Variable | Unit | Min | Max | Mean | Missing %\nWind Speed | m/s | 0.0 | 58.4 | 4.2 | 0.2%"]
PAYMENT = ["Payment Schedule | Amount (USD) | Due Date\nQ2 2025 | $61,250 | July 15, 2025"]
DIVISION = ["Division | Q3 2025 Revenue | Q3 2024 Revenue | YoY Growth\nEnterprise Solutions | $412.5M | $348.7M | +18.3%"]
LEADERS = ["Current Leadership\nCEO: Dr. Sarah Chen (since January 2022)\nCTO: James Whitfield (co-founder, since 1998)"]
RECORDS = ["Calibration records are stored in the maintenance log for five years."]
YES, NO, OPEN = R.SUPPORTED, R.CONTRADICTED, R.INSUFFICIENT
CASES = [
    ("Records are kept for 5 years.", ["Calibration records are retained for five years."], None, [], YES),
    ("The lidar array requires calibration every 90 days.", LIDAR, None, [], NO),
    ("The lidar array requires calibration every 30 weeks.", LIDAR_ONE, None, [], NO),
    ("The sensor array requires calibration every 30 days.", LIDAR_ONE, None, [], OPEN),
    ("The lidar array requires calibration every 30 days.", LIDAR, None, [], YES),
    ("The lidar array requires calibration every 45 days.", LIDAR_ONE, None, [], NO),
    ("Calibration can correct a physically damaged lidar unit.", ["Calibration cannot correct a physically damaged lidar unit."], None, [], NO),
    ("Manual calibration is cheaper than automated calibration.", ["Manual calibration is more accurate on damaged hardware, while automated calibration is cheaper for a large fleet."], None, [], NO),
    ("Elena Vasquez is the CFO.", ["CTO: James Whitfield, CFO: Robert Tanaka, COO: Elena Vasquez."], None, [], NO),
    ("A worn bearing causes repeated failures on the same axis.", ["Repeated failures on the same axis indicate a worn bearing."], None, [], OPEN),
    ("The system uses TensorFlow.", ["The system uses sentence transformer models."], None, [], OPEN),
    ("every 30 days", LIDAR_ONE, "How often is the lidar array calibrated?", [], YES),
    ("30 days", LIDAR_ONE, None, [], YES),
    ("1", LIDAR_ONE, None, [], OPEN),
    ("1", LIDAR_ONE, "What was the population of Norway in 1998?", [], OPEN),
    ("every 90 days", LIDAR_ONE, "How often is the lidar array calibrated?", [], OPEN),
    ("Manual calibration is always more accurate than automated calibration.", ["Manual calibration is more accurate on damaged hardware."], None, [], OPEN),
    ("Calibration records are kept for the warranty period of five years.", RECORDS, None, [], OPEN),
    ("Calibration records are kept for five years.", RECORDS, None, [], YES),
    ("4.2", WIND, "What is the mean for Wind Speed?", [], YES),
    ("0.0.", WIND, "What is the mean for Wind Speed?", [], NO),
    ("m/s.", WIND, "What is the variable for Wind Speed?", [], OPEN),
    ("$412.5M", DIVISION, "According to the table, what is the division for Enterprise Solutions?", [], OPEN),
    ("$61,250.", PAYMENT, "How much is the payment schedule of Q2 2025?", [], YES),
    ("$3", ["Net income attributable to shareholders was $142.6 million, or $3."], "What was the reported monetary value?", [], NO),
    ("1", ["1 percent from 20.3 percent."], "What does the document say about percentage?", [], NO),
    ("/auth/token, Obtain access token.", ["Method | Endpoint | Description | Auth Required\nPOST | /auth/token | Obtain access token | No"], "What are all the values for POST?", [], YES),
    ("Dr. Sarah Chen", LEADERS, "Who is the CEO?", [], YES),
    ("The lidar array is calibrated every 30 days and the records are kept for five years.", [LIDAR_ONE[0], "Calibration records are retained for five years."], None, [], YES),
    ("The lidar array requires calibration every 30 days.", [LIDAR_ONE[0], "The power rail operates at 12 volts."], None, [2], YES),
    ("The lidar array requires calibration every 30 days.", LIDAR_ONE, None, [1], YES),
    ("The lidar is calibrated monthly.", [], None, [], OPEN),
    ("   ", LIDAR, None, [], OPEN),
    (None, LIDAR, None, [], OPEN),
    ("The lidar array requires calibration every 30 days [1].", [" ".join(f"Sentence number {i} describes a maintenance step for module {i}." for i in range(400))], None, [], OPEN),
]


@pytest.fixture(scope="module")
def judged(spark):
    claims = [(i, i, claim, question, stated) for i, (claim, _, question, stated, _) in enumerate(CASES)]
    blocks = [(i, k + 1, text) for i, (_, texts, *_) in enumerate(CASES) for k, text in enumerate(texts)]
    c = spark.createDataFrame(claims, "claim_id long, answer_id long, claim string, question string, stated array<int>")
    b = spark.createDataFrame(blocks, "answer_id long, block int, content string")
    rows = R.verify_claims(c, b).collect()
    assert len(rows) == len(CASES)
    return {r.claim_id: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_decisions(judged, i):
    assert judged[i].label == CASES[i][4], CASES[i][:3]


def test_blocks_and_citations(judged):
    at = {CASES[i][0]: judged[i] for i in judged if CASES[i][3] or "and the records" in (CASES[i][0] or "")}
    assert at["The lidar array is calibrated every 30 days and the records are kept for five years."].supporting == [1, 2]
    wrong, right = (judged[i] for i in judged if CASES[i][3])
    assert (wrong.citation_ok, right.citation_ok) == (False, True) and [r.misbound for r in judged.values()].count(True) == 2


def test_paraphrase_needs_a_model(spark):
    c = spark.createDataFrame([(1, 1, "The robot cannot be dispatched while a calibration failure is unresolved.", None, [])], "claim_id long, answer_id long, claim string, question string, stated array<int>")
    b = spark.createDataFrame([(1, 1, "A failed calibration check blocks the robot from dispatch until it is resolved.")], "answer_id long, block int, content string")
    assert R.verify_claims(c, b, F.lit(0.9)).first().label == YES and R.verify_claims(c, b).first().label == OPEN


def test_sentences(spark):
    text = "CEO: Dr. Sarah Chen (since 2022). Next one!  Third etc. Nothing failed. The U.S. team ran\nwrapped lines. J. Smith paid $8.3M. He left... Then e.g. 3.5 m\nNew Line\n\n(joined)"
    want = ["CEO: Dr. Sarah Chen (since 2022).", "Next one!", "Third etc.", "Nothing failed.", "The U.S. team ran wrapped lines.", "J. Smith paid $8.3M.", "He left...", "Then e.g. 3.5 m", "New Line (joined)"]
    assert spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s == want
