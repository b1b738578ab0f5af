"""Claims meet their blocks once, whether the sides are small enough to go to every task or not."""

from docweft.operators import claims


def test_same_blocks_by_either_way(spark, monkeypatch):
    known = spark.createDataFrame([(1, ["red", "fox", "den"], []), (2, ["blue", "pump"], ["7"]), (3, [], []), (4, ["absent"], [])], "claim_id long, tokens array<string>, numbers array<string>")
    blocks = spark.createDataFrame([(i, ["red", "fox"] if i % 3 else ["blue", "pump", "red"], ["7"] if i % 2 else []) for i in range(60)], "block_id long, tokens array<string>, numbers array<string>")
    want = {(1, i) for i in range(60) if i % 3} | {(2, i) for i in range(60) if i % 3 == 0 and i % 2}
    for most in (1 << 18, 0):
        for name in ("MOST_TERMS", "MOST_BLOCKS", "MOST_KNOWN"):
            monkeypatch.setattr(claims, name, most, raising=False)
        found = claims.attribute(known, blocks)
        assert {(r.claim_id, r.block_id) for r in found.collect()} == want
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
