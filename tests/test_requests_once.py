"""What stands before requests is folded once, not again for the answer."""

import __spark_entry__ as entry


def test_the_answer_holds_one_fold(spark):
    asked = entry.queries()["claim_requests"](spark, "/root/testdata/sf0.001")
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
