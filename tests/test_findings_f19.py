"""citations are counted before laws and their names come to them."""

import re

from graphloom import plans
from graphloom.operators import graph
from graphloom.plans import catalog


plans.load()


def test_counted_before_names(spark, sf):
    ents = spark.createDataFrame([("c1", "legal_claim", "x", "a"), ("c2", "legal_claim", "y", "a"), ("l1", "law", "L", None), ("l2", "law", "M", None), ("o", "legal_outcome", "O", None)], "id string, type string, name string, claim_type string")
    lines = spark.createDataFrame([("l1", "c1", "CITES"), ("l1", "c2", "CITES"), ("c1", "l1", "ENABLES"), ("l2", "c2", "CITES"), ("c1", "o", "RESULTS_IN"), ("l1", "l1", "CITES")], "src string, dst string, type string")
    met = graph.laws_for_claims(ents, lines)
    assert sorted(map(tuple, met.collect())) == [("a", "l1", "L", 3), ("a", "l2", "M", 1)]
    assert re.search(r"Aggregate \[claim_type#\d+, other#\d+\]", met._jdf.queryExecution().optimizedPlan().toString())
    plan = catalog.QUERIES["e3_law_citations"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[other#\d+\]", plan) and "FILED_IN" not in plan
