"""a row's remedies meet its own laws."""

from graphloom.operators import proof


def test_verified_by_row(spark):
    laws = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "x"), (4, "a"), (5, None)], "key int, law string")
    remedies = spark.createDataFrame([(1, "r"), (1, "s"), (2, "s"), (3, "r"), (5, "r"), (6, "r")], "key int, remedy string")
    entities = spark.createDataFrame([("a",), ("b",), ("r",)], "id string")
    edges = spark.createDataFrame([("a", "r", "AUTHORIZES"), ("b", "s", "AUTHORIZES"), ("a", "s", "CITES")], "src string, dst string, type string")
    out = proof.verified(laws, remedies, entities, edges)
    assert sorted(map(tuple, out.collect())) == [(1, True, True), (2, True, False), (3, False, False), (4, True, True), (5, False, False)]
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and all("key#" in line for line in joins)
