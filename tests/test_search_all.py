"""A search without a limit returns all hits, redacts each in the task where it lies, and does so once."""

from pyspark.sql import functions as F

from siltstone.operators import serve
from siltstone.plans import more  # noqa: F401  (registers its queries)
from siltstone.plans.registry import QUERIES


def test_all_hits_are_redacted_once_where_they_lie(spark):
    k = F.col("id").cast("string")
    pages = spark.range(400).repartition(8).select(k.alias("id"), F.lit("note").alias("title"), F.concat(F.lit("license of version ghp_"), F.md5(k.cast("binary"))).alias("body"), *(F.lit("p").alias(c) for c in ("path", "type")), F.lit("public").alias("sensitivity"), F.lit("clean").alias("taint"), F.lit("a").alias("authority"), *(F.array(k).alias(c) for c in ("subjects", "sources")))
    events = spark.createDataFrame([], "event_id long, connector string, kind string, text string, hint string, occurred_at timestamp_ntz, subjects array<string>")
    found, labels = serve.search(serve.documents(pages, events), "Which license version was released?", 1, limit=None)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 400 and labels == ["query-relaxed"]
    assert len({r.task for r in rows}) > 1 and not any("ghp_" in r.excerpt for r in rows)
    literal, _ = serve.search(serve.documents(pages, events), "license version", 1, limit=None)
    assert literal.count() == 400


def test_the_query_has_no_limit_and_redacts_once(spark):
    plan = QUERIES["search_tool_question"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and max(line.count("regexp_replace") for line in plan.splitlines()) < 100
