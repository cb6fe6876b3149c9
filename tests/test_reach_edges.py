"""A walk makes its edges once, whatever its steps."""

from pyspark.sql import functions as F

from siltstone.operators import graph as G


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(node):
        made.add(1)
        return node

    edges = spark.createDataFrame([(n, n + 1) for n in range(6)] + [(3, 0)], "src long, dst long")
    edges = edges.withColumn("dst", F.udf(counted, "long").asNondeterministic()("dst"))
    start = spark.createDataFrame([(0,)], "node long")
    found = sorted((r["node"], r["hops"], r["parent"]) for r in G.reach(edges, start, 5).collect())
    assert found == [(0, 0, None)] + [(n, n, n - 1) for n in range(1, 6)]
    assert made.value == 7
