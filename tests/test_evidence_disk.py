"""Claims meet evidence without pairs on disk: few claims go to every task, and many give the same answers by shuffles."""

import pytest

from docweft.operators import claims, relations, service

WORDS = "pump tank valve motor filter sensor blade rotor"
ASKED = [(1, WORDS.split()[:4], []), (2, WORDS.split()[2:7], ["7"]), (3, [], []), (4, ["gasket", "pump"], []), (5, ["rotor"], [])]


def _blocks(spark):
    rows = [(i, [w for j, w in enumerate(WORDS.split()) if (i >> j) & 1], ["7"] * (i % 3 == 0)) for i in range(256)]
    return spark.createDataFrame([*rows, (5, WORDS.split(), ["7"])], "block_id long, tokens array<string>, numbers array<string>")


@pytest.mark.parametrize("most", [0, 20_000])
def test_supporting_blocks(spark, monkeypatch, most):
    """By every task or by shuffles; a block that comes in two rows is judged in each."""
    monkeypatch.setattr(claims, "MOST_KNOWN", most)
    asked = spark.createDataFrame(ASKED, "claim_id long, tokens array<string>, numbers array<string>")
    blocks = _blocks(spark)
    want = []
    for b in blocks.collect():
        for claim, tokens, numbers in ASKED:
            shared = len(set(tokens) & set(b.tokens))
            if tokens and shared >= -int(-(len(tokens) * (0.45 if numbers else 0.6) - 1e-9) // 1) and set(numbers) <= set(b.numbers):
                want.append((claim, b.block_id, round(shared / len(tokens), 6)))
    assert sorted(tuple(r) for r in claims.attribute(asked, blocks).collect()) == sorted(want)


def test_no_pair_is_written(spark, monkeypatch):
    """257 blocks share words with 50 claims, each supported by two: what is written are blocks, words of claims and the result."""
    written = []
    monkeypatch.setattr(claims, "durable", lambda df, durable=claims.durable: written.append(durable(df)) or written[-1])
    monkeypatch.setattr(claims, "release", lambda *frames: None, raising=False)
    asked = spark.createDataFrame([(i, [*WORDS.split(), *(f"w{i}-{k}" for k in range(5))], []) for i in range(50)], "claim_id long, tokens array<string>, numbers array<string>")
    assert claims.attribute(asked, _blocks(spark)).count() == 100
    assert max(df.count() for df in written) == 257


def test_few_and_many_claims_are_judged_alike(spark, monkeypatch):
    told = [("1:0", 1, 0, "The pump runs at 40 bar."), ("1:1", 1, 1, "The pump has a steel tank and the motor is red."), ("2:0", 2, 0, "Tanks are not made of steel."), ("2:1", 2, 1, "The motor is blue.")]
    blocks = spark.createDataFrame([(1, 10, "The pump runs at 40 bar. The tank of the pump is steel."), (1, 11, "The motor is red.\nThe pump runs at 50 bar."), (2, 12, "Tanks are made of steel. The motor is blue."), (2, 13, "The motor is blue.")], "answer_id long, block long, content string")
    asked = spark.createDataFrame([(*t, None, []) for t in told], "claim_id string, answer_id long, place int, claim string, question string, stated array<long>")
    got = {}
    for way in ("few", "many"):
        if way == "many":
            monkeypatch.setattr(relations, "small", lambda df: df)
        verdicts = relations.verify_claims(asked.drop("place"), blocks).collect()
        got[way] = sorted(map(str, verdicts)), sorted(map(str, service.retain_supported(asked, blocks).collect()))
    assert got["few"] == got["many"]
    assert "SUPPORTED" in str(got["few"]) and "repaired=True" in str(got["few"])
