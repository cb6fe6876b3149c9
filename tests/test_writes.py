"""Scans over the whole log and the fold of claims, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import fold, scan
from siltstone.operators import ledger as L

DAY = datetime(2024, 1, 1)


def test_numbers_are_dense_with_a_payload(spark):
    rows = spark.range(0, 60_000, 1, 5).select((F.xxhash64("id") % 900).alias("at"), "id", F.repeat(F.lit("x"), 20).alias("payload"), F.rand(3).alias("noise"))
    got = [(r.at, r.id, r.number) for r in L.numbered(rows, "at", "id", parts=7).select("at", "id", "number").collect()]
    assert [(a, i, n + 10) for n, (a, i) in enumerate(sorted((a, i) for a, i, _ in got))] == sorted((a, i, n + 9) for a, i, n in got)
    assert L.numbered(rows.where("false"), "at", "id").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_running_values_over_a_hot_group(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 1, 2, None, 3]), i, rng.choice([None, *range(50)])) for i in range(400)]
    table = scan.ranged(spark.createDataFrame(rows, "g int, i int, v int").repartition(4), "g", "i", parts=parts)
    for upto in (0, -1):
        got = {r.i: r for r in scan.running(table, ("g",), ("i",), ("s", "sum", F.col("v")), ("m", "max", F.col("v")), ("least", "min", F.col("v")), ("l", "last", F.col("v")), upto=upto).collect()}
        for g, i, _ in rows:
            seen = [v for g2, i2, v in rows if g2 == g and i2 <= i + upto and v is not None]
            want = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4
            assert (got[i].s, got[i].m, got[i].least, got[i].l) == want
    assert len(got) == len(rows)


def test_a_clock_that_goes_back_across_keys(spark):
    history = spark.createDataFrame([(1, DAY + timedelta(1), "a", "x"), (2, DAY, "b", "x"), (3, DAY + timedelta(2), "a", "y")], "sequence int, recorded_at timestamp_ntz, record string, status string")
    states = spark.createDataFrame([("a", "y"), ("b", "x")], "record string, status string")
    assert {r.rule: r.n for r in L.integrity(history, states).collect()} == {"clock_back": 1, "state_differs": 0, "orphan_entry": 0, "no_history": 0}


def test_suppressed_rows_are_no_earlier_rows(spark):
    batch = spark.createDataFrame([(1, DAY, "gone", "k", True), (2, DAY, "b", "k", False), (3, DAY, "b", "k", True), (4, DAY, "c", "k", True), (5, DAY, "c", None, True), (6, DAY, "c", None, True)], "event_id long, accepted_at timestamp_ntz, record string, key string, ok boolean")
    gone = spark.createDataFrame([("gone",)], "record string")
    got = L.accepted(batch, batch.where("false"), gone, F.col("ok"), "key").orderBy("event_id").collect()
    assert [r.outcome for r in got] == ["suppressed", "error", "stored", "duplicate", "stored", "duplicate"]
    held = L.accepted(batch, spark.createDataFrame([(None,)], "key string"), gone, F.col("ok"), "key").orderBy("event_id").collect()
    assert [r.outcome for r in held][4:] == ["duplicate", "duplicate"]


def claim(i, key="k", obj="a", start=0, end=None, tier=2, confidence=0.5, polarity="positive", **more):
    return {"claim_id": i, "claim_key": key, "object": obj, "valid_from": start, "valid_to": end, "tier": tier, "confidence": confidence, "polarity": polarity, "single": True, "purged": False, "dry": False, "body": None, "sensitivity": 0, "provenance": [f"e{i}"], "roots": [f"r{i}"], "corroboration": 1} | more


def outcomes(*claims, most=1 << 20):
    """The fold without components: every claim meets all live ones of its key."""
    held, done = fold.Component(most), []
    for c in claims:
        done += held.file(dict(c))
    done += held.live.values()
    return {r["claim_id"]: r for r in done}


def test_equal_claims_meet_by_overlap_not_by_start():
    got = outcomes(claim(1, start=0, end=10), claim(2, start=5, end=20), claim(3, start=10, end=30), claim(4, start=40))
    assert [got[i]["outcome"] for i in (1, 2, 3, 4)] == ["stored", "duplicate", "stored", "stored"] and got[2]["met"] == 1
    assert got[1]["corroboration"] == 2 and got[1]["provenance"] == ["e1", "e2"]


def test_only_live_claims_count_and_only_the_incoming_one_is_contested():
    got = outcomes(claim(1, obj="a", tier=3), claim(2, obj="b", tier=1), claim(3, obj="b", tier=2), claim(4, obj="c", tier=4, start=7), claim(5, obj="b", tier=3))
    assert [got[i]["outcome"] for i in (1, 2, 3, 4, 5)] == ["stored", "skipped", "skipped", "stored", "skipped"]
    assert (got[1]["status"], got[1]["by"], got[1]["rule"], got[1]["valid_to"]) == ("superseded", 4, "R5", 7) and got[5]["rule"] == "R1"
    even = outcomes(claim(1, obj="a", confidence=0.5), claim(2, obj="b", start=1, confidence=0.6))
    assert [even[i]["outcome"] for i in (1, 2)] == ["stored", "contested"] and {r["status"] for r in even.values()} == {"live"} and even[2]["met"] == 1


def test_decisions():
    of = lambda new, old: fold.decide(claim(2, **new), claim(1, **old))
    assert of({}, {"purged": True, "tier": 4}) == ("R6", "replace")
    assert of({"tier": 4}, {"tier": 3}) == ("R5", "replace") and of({"tier": 3}, {"tier": 4}) == ("R1", "skip")
    assert of({"tier": 1}, {"tier": 2}) == ("R2", "skip") and of({"tier": 1}, {"tier": 4}) == ("R1", "skip") and of({"tier": 3}, {"tier": 2}) == ("R1", "replace")
    assert of({"tier": 4}, {"tier": 4}) == ("R3", "replace") and of({"tier": 3, "start": -1}, {"tier": 3}) == ("R3", "skip")
    assert of({"confidence": 0.65}, {"confidence": 0.5}) == ("R3", "replace") and of({"confidence": 0.64}, {"confidence": 0.5}) == ("R4", "contest")
    assert of({"start": 1, "confidence": 0.1}, {"confidence": 0.9}) == ("R4", "contest")


def test_replays_dry_runs_and_the_bound():
    got = outcomes(claim(1, body="x", end=1), claim(2, body="x", start=50, sensitivity=2), claim(3, obj="b", tier=4, dry=True), claim(4, obj="a", start=0, end=1))
    assert got[2]["outcome"] == "duplicate" and got[2]["met"] == 1 and got[1]["sensitivity"] == 2
    assert (got[3]["outcome"], got[3]["status"], got[3]["replaced"], got[1]["status"]) == ("stored", None, 1, "live") and got[4]["outcome"] == "duplicate"
    same = outcomes(claim(1), claim(2, provenance=["e1"], confidence=0.9), claim(3, provenance=["e3"], roots=["r1"], confidence=0.8))
    assert (same[1]["corroboration"], same[1]["confidence"]) == (1, 0.8)
    full = outcomes(*(claim(i, obj=str(i), single=False) for i in range(6)), most=3)
    assert [full[i]["outcome"] for i in range(6)] == ["stored"] * 4 + ["beyond"] * 2


def test_fold_over_a_hot_key(spark):
    """One key holds nearly all claims, in runs apart from each other; components over ranges agree with one long fold."""
    rng = random.Random(8)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([0, 0, 1, 1, 2, 9])
        rows.append((i, "hot" if i % 10 else None if i % 20 else "cold", rng.choice("abc"), DAY + timedelta(at + rng.randint(0, 3)), None if i > 280 else DAY + timedelta(at + rng.randint(0, 5)), rng.randint(1, 4), rng.randint(0, 9) / 10, rng.choice(["positive", "negative"]), rng.choice([None, None, "x", "y", f"own {i}"])))
    rng.shuffle(rows)
    table = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "claim_id long, claim_key string, object string, valid_from timestamp_ntz, valid_to timestamp_ntz, tier int, confidence double, polarity string, body string").withColumn("sensitivity", F.lit(0))
    got = {r.claim_id: r for r in fold.filed(table, parts=9).collect()}
    want = {}
    for key in ("hot", "cold"):
        want |= outcomes(*(claim(n, r[1], r[2], r[3], r[4], r[5], r[6], r[7], body=r[8], provenance=[str(n)], roots=[str(n)]) for n, r in enumerate(rows) if r[1] == key))
    assert len(got) == len(rows) and all(got[n].outcome in ("stored", "duplicate") for n, r in enumerate(rows) if r[1] is None)
    for n, r in want.items():
        assert (got[n].outcome, got[n].status, got[n].met, got[n].by, got[n].rule, got[n].valid_to, got[n].corroboration) == (r["outcome"], r["status"], r.get("met"), r.get("by"), r.get("rule"), r["valid_to"], r["corroboration"])
    parts = fold.components(table, parts=9).where("claim_key = 'hot'").select("component").distinct().count()
    assert parts > 20
    assert fold.filed(table.where("false")).count() == 0


def test_as_of_against_a_loop(spark):
    rng = random.Random(2)
    history = [(rng.choice([1, 1, 1, 2]), rng.randint(0, 40), i, f"s{i}") for i in range(120)]
    asked = [(rng.choice([1, 1, 2, 3]), rng.randint(-2, 45), i) for i in range(60)]
    support = [(rng.choice([1, 2]), rng.randint(0, 40)) for _ in range(50)]
    got = scan.as_of(spark.createDataFrame(asked, "k int, at int, ask int"), spark.createDataFrame(history, "k int, at int, seq int, state string"), "k", "at", ("state",), "seq", spark.createDataFrame(support, "k int, at int"), parts=7).collect()
    assert len(got) == len(asked)
    for r in got:
        before = sorted((at, i, s) for k, at, i, s in history if k == r.k and at <= r.at)
        assert (r.state and r.state.state) == (before[-1][2] if before else None)
        assert (r.n_known or 0, r.n_counted or 0) == (len(before), sum(k == r.k and at <= r.at for k, at in support))
