"""Recurrence rules against days worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from siltstone.sources import recurrence as RR

CASES = [  # start, rule, days before 2025
    ("2024-01-31", "FREQ=MONTHLY;COUNT=4", ["2024-01-31", "2024-03-31", "2024-05-31", "2024-07-31"]),
    ("2024-02-29", "FREQ=YEARLY", ["2024-02-29"]),
    ("2024-09-02", "freq=monthly;byday=1mo;count=3", ["2024-09-02", "2024-10-07", "2024-11-04"]),
    ("2024-11-01", "FREQ=MONTHLY;BYDAY=-1FR", ["2024-11-29", "2024-12-27"]),
    ("2024-12-29", "FREQ=WEEKLY;INTERVAL=2;BYDAY=SU,TU", ["2024-12-29"]),  # weeks start on Monday
    ("2024-12-29", "FREQ=WEEKLY;INTERVAL=2;BYDAY=SU,TU;WKST=SU", ["2024-12-29", "2024-12-31"]),
    ("2024-01-01", "FREQ=MONTHLY;BYMONTHDAY=13;BYDAY=FR", ["2024-09-13", "2024-12-13"]),
    ("2024-06-01", "FREQ=YEARLY;BYMONTH=11;BYDAY=4TH", ["2024-11-28"]),
    ("2024-12-25", "FREQ=DAILY;INTERVAL=3;UNTIL=20241229T000000Z", ["2024-12-25", "2024-12-28"]),
    ("2024-12-30", "FREQ=DAILY;BYDAY=MO", ["2024-12-30"]),  # not understood: the event once
    ("2024-12-30", "FREQ=WEEKLY;BYDAY=1MO", ["2024-12-30"]),
    ("2024-12-30", "FREQ=DAILY;INTERVAL=0", ["2024-12-30"]),
    ("2024-12-30", None, ["2024-12-30"]),
    (None, "FREQ=DAILY", []),
    ("2025-03-01", "FREQ=DAILY", []),  # beyond the end of search
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, s and dt.date.fromisoformat(s), r) for i, (s, r, _) in enumerate(CASES)], "i int, start date, rule string")
    found = RR.expanded(rows, "i", "start", "rule", F.lit("2024-12-31")).orderBy("i", "n").collect()
    assert [[str(r.day) for r in found if r.i == i] for i in range(len(CASES))] == [days for *_, days in CASES]
    assert RR.expanded(rows.where("false"), "i", "start", "rule", F.lit("2024-12-31")).count() == 0


def test_exceptions_count_and_the_last_days_stay(spark):
    day = lambda s: F.lit(s).cast("date")
    one = spark.range(1).select("id", day("2024-01-01").alias("start"), F.lit("FREQ=DAILY;COUNT=4").alias("rule"), F.lit(7).alias("n"), F.array(day("2024-01-02"), day("2024-02-01")).alias("without"))
    one = one.withColumn("more", F.array(day("2024-02-01"), day("2024-01-03"), day("2024-03-01"))).withColumn("nothing", F.lit(None).cast("array<date>"))
    of = lambda *a, **k: [str(r.day) for r in RR.expanded(one, "id", "start", "rule", F.lit("2024-12-31"), *a, **k).orderBy("n").collect()]
    assert of("without", "more") == ["2024-01-01", "2024-01-03", "2024-01-04", "2024-03-01"]
    assert of(most=2) == ["2024-01-03", "2024-01-04"]
    assert len(of("nothing", "nothing")) == 4


def test_candidate_days_follow_the_periods(spark):
    """All days that fit are candidates, whatever the rule, and no more than a few for each period."""
    rules = ["FREQ=DAILY;INTERVAL=7", "FREQ=WEEKLY;INTERVAL=3;BYDAY=SU,MO;WKST=SU", "FREQ=WEEKLY;WKST=TH", "FREQ=MONTHLY;BYDAY=-1FR,2TU,WE", "FREQ=MONTHLY;BYMONTHDAY=31,1,-30", "FREQ=MONTHLY;INTERVAL=5;BYMONTHDAY=13;BYDAY=FR",
             "FREQ=YEARLY;INTERVAL=2;BYDAY=53MO,-1SU,TH", "FREQ=YEARLY;BYMONTHDAY=30", "FREQ=YEARLY;BYMONTH=2,11", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", "FREQ=MONTHLY", "FREQ=YEARLY"]
    starts = [dt.date(2023, 12, 31), dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 7, 3)]
    rows = spark.createDataFrame([(s, r) for s in starts for r in rules], "r_start date, r_rule string").withColumn("r_last", F.lit("2029-01-31").cast("date")).withColumns(RR._parsed(F.col("r_rule")))
    every = F.filter(F.sequence("r_start", "r_last"), RR._fits)
    got = rows.select("r_rule", "r_ok", every.alias("a"), F.array_sort(F.array_distinct(F.filter(RR._candidates(), RR._fits))).alias("b"), F.size(RR._candidates()).alias("n")).collect()
    assert all(r.r_ok and list(r.a) == list(r.b) for r in got), [r.r_rule for r in got if list(r.a) != list(r.b)]
    assert max(r.n for r in got if r.r_rule in ("FREQ=MONTHLY", "FREQ=YEARLY", "FREQ=DAILY;INTERVAL=7")) < 300


def test_a_rule_is_read_once_for_equal_events(spark, capsys):
    """No filter asks for an event's days before equal events are one."""
    rows = spark.range(3000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("start"))
    rows = rows.withColumn("rule", F.when(F.col("id") % 3 == 2, "FREQ=DAILY;UNTIL=20231231").otherwise("FREQ=WEEKLY;COUNT=3"))
    found = RR.expanded(rows, "id", "start", "rule", F.lit("2024-12-31"))
    capsys.readouterr()
    found.explain(True)
    filters = [line for line in capsys.readouterr().out.splitlines() if line.lstrip(" :+-*()0123456789").startswith("Filter")]
    assert filters and not [line for line in filters if "regexp_extract" in line or "size(" in line]
    assert found.count() == 2000 * 3 and found.where("id % 3 = 2 OR n IS NULL OR day IS NULL").count() == 0
