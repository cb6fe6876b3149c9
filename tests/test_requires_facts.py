"""A walk makes its facts once, whatever its levels."""

from pyspark.sql import functions as F

from siltstone.operators import requires as R


def test_facts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(claim):
        made.add(1)
        return claim

    rows = [(f"c{n}{k}", f"n{n + 1}", f"n{n}", "positive", ["e"]) for n in range(6) for k in range(2)]
    facts = spark.createDataFrame(rows, "claim_id string, dependent string, required string, polarity string, events array<string>")
    facts = facts.withColumn("claim_id", F.udf(counted, "string").asNondeterministic()("claim_id"))
    found = R.impact(facts, "n0", depth=4)
    assert [i for i, *_ in found.current] == ["n1", "n2", "n3", "n4"] and found.truncated
    assert found.current[1][2] == ["c00", "c01", "c10", "c11"]
    assert made.value == len(rows)
