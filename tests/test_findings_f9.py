"""claims are not dealt out by their few types."""

from graphloom.operators import proof


def test_claims_stay_where_they_are(spark, monkeypatch):
    claims = spark.createDataFrame([(f"c{i}", f"t{i % 2}") for i in range(20)] + [("x", None), ("y", "other")], "claim string, claim_type string")
    required = spark.createDataFrame([("t0", "a", True), ("t0", "b", False), ("t1", "a", False)], "claim_type string, evidence_id string, is_critical boolean")
    shown = spark.createDataFrame([("c0", "a"), ("c0", "a"), ("c1", "b")], "claim string, evidence_id string")
    want = sorted((f"c{i}", f"t{i % 2}", e, c, (f"c{i}", e) == ("c0", "a")) for i in range(20) for e, c in ((("a", True), ("b", False)) if i % 2 == 0 else (("a", False),)))
    monkeypatch.setattr("graphloom.operators.proof.SENT_REQUIRED", 0)
    assert sorted(map(tuple, proof.satisfied_by_name(claims, required, shown).collect())) == want
    monkeypatch.setattr("graphloom.operators.proof.SENT_REQUIRED", 100_000)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = proof.satisfied_by_name(claims, required, shown)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any("hashpartitioning(claim_type" in line for line in plan.splitlines())
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
