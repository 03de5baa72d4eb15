"""a case's elements meet the texts of that case alone."""

from pyspark.sql import functions as F

from graphloom.operators import containment


def test_elements_meet_by_case_and_text(spark):
    named = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("Brand#"), F.least(F.lit(1), F.col("id") + 1)).alias("name"))
    shown = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("brand#1 part "), "id").alias("text"))
    out = containment.elements(named, shown)
    assert {(r.key, r.satisfied, tuple(r.evidence)) for r in out.collect()} == {(i, True, (f"brand#1 part {i}",)) for i in range(400)}
    # Meeting by the part first would make 400 * 400 rows, which the case then cuts.
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert sum("key#" in line for line in joins) == 1 and any("key#" in line and "part#" in line for line in joins), joins
