"""The persisted index and the streams: pruning, batches that run again, erasure, restarts."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import inverted as V
from siltstone.operators import ledger as L
from siltstone.operators import search as Q
from siltstone.streaming import ingest as I
from siltstone.streaming import retract as T

PAGE = "doc long, version int, title string, body string, machine boolean, deleted boolean"


def pages(spark, *rows):
    return spark.createDataFrame([(d, v, t, b, m, b is None) for d, v, t, b, m in rows], PAGE)


@pytest.fixture
def index(spark, tmp_path):
    return V.Index(str(tmp_path / "index"), buckets=16)


def test_words_fold():
    assert V.words("Café CAFÉ cafe, İx naïve_99 Ａ") == ["cafe", "cafe", "cafe", "ix", "naive", "99", "ａ"]


def test_search_reads_only_the_buckets_of_its_words(spark, index):
    V.apply(index, pages(spark, (1, 0, "One", "the café is open", False), (2, 0, "Two", "cafes and other things", False)), "a")
    plan = V.postings(spark, index, [("cafe", False)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#").replace("[bucket", "[bucket") or "bucket" in plan.split("PartitionFilters")[1][:60]
    files = {r[0] for r in V.postings(spark, index, [("cafe", True)]).select(F.input_file_name()).collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
    assert [r.doc for r in V.literal(spark, index, "CAFÉ", 9).collect()] == [1]
    assert sorted(r.doc for r in V.literal(spark, index, "cafe*", 9).collect()) == [1, 2]
    assert [r.doc for r in V.literal(spark, index, '"is open"', 9).collect()] == [1] and V.literal(spark, index, '"open is"', 9).count() == 0
    assert V.literal(spark, index, "AND", 9).count() == 0
    assert [r.exact for r in V.literal(spark, index, "One", 9).collect()] == [True]


def test_batches_replace_erase_and_run_again(spark, index):
    first = pages(spark, (1, 0, "a", "red red blue", False), (2, 0, "b", "red", True), (3, 0, None, None, False), (4, 0, "", "", False), (1, -1, "old", "green", False))
    assert V.apply(index, first, "a") and not V.apply(index, first, "a")
    seen = lambda w: sorted((r.doc, len(r.body)) for r in V.postings(spark, index, [(w, False)]).collect())
    assert seen("red") == [(1, 2), (2, 1)] and seen("green") == []
    V.apply(index, pages(spark, (1, 1, "a", "green", False), (2, 1, None, None, False), (9, 1, "n", "red", False)), "b")
    assert seen("red") == [(9, 1)] and seen("green") == [(1, 1)] and seen("blue") == []
    rows = V.manifest(spark, index)
    assert sum(r["n_docs"] for r in rows) == 3 and sum(r["n_words"] for r in rows) == (1 + 4) + (1 + 4) + 0
    V.apply(index, pages(spark, (2, 2, "b", "red again", False)), "c")
    assert seen("red") == [(2, 1), (9, 1)]
    before = sorted(tuple(r) for r in V.bm25(spark, index, ["red", "green"]).collect())
    segment = V.compacted(spark, index)
    assert sorted(tuple(r) for r in V.bm25(spark, index, ["red", "green"]).collect()) == before and len(V.manifest(spark, index)) == 1
    held = spark.read.parquet(f"{index.path}/{segment}/postings")
    assert {r.term for r in held.collect()} == {"a", "b", "n", "green", "red", "again"} and held.where("term = 'blue'").count() == 0
    V.apply(index, pages(spark, (2, 3, None, None, False), (9, 3, None, None, False)), "d")
    erased = V.compacted(spark, index)
    assert spark.read.parquet(f"{index.path}/{erased}/postings").where("doc IN (2, 9)").count() == 0 and seen("red") == []


def test_index_agrees_with_the_scan(spark, index):
    rng = random.Random(5)
    words = ["the", "an", "ant", "note", "license", "licensed", "x", "the"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randint(0, 40))), i % 3 == 0) for i in range(60)], "doc long, title string, body string, machine boolean")
    V.apply(index, docs.withColumns({"version": F.lit(0), "deleted": F.lit(False)}), "a")
    for q in ("the an*", '"the the"', '"an note" lic*', "x", "note NOT the"):
        got = [(r.doc, r.exact, round(r.score, 12)) for r in V.literal(spark, index, q, 60).collect()]
        assert got == [(r.doc, r.exact, round(r.score, 12)) for r in Q.literal(docs, q, "title", "body", "doc", 60, F.col("machine")).collect()], q
    close = lambda rows: {r.doc: round(r.score, 9) for r in rows.collect()}
    assert close(V.bm25(spark, index, ["the", "license", "none"])) == close(Q.bm25(docs, ["the", "license", "none"], "doc", "body", "title"))
    terms, need = Q.relaxed_terms("what did they note about licensed things?")
    assert {(r.doc, r.covered) for r in V.relaxed(spark, index, terms, need - 1).collect()} == {(r.doc, r.covered) for r in Q.relaxed(docs, terms, need - 1, "body").collect()}


def test_empty_index(spark, index):
    assert V.postings(spark, index).count() == 0 and V.literal(spark, index, "a", 5).count() == 0 and V.bm25(spark, index, ["a"]).count() == 0


ROW = "event_id long, accepted_at timestamp_ntz, record long, deleted boolean"


def test_retraction_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(minutes=rng.randint(0, 40)), rng.choice([1, 1, 1, 2, 3]), rng.random() < 0.2) for i in range(150)]
    want = {(r.record, r.event_id) for r in L.live(spark.createDataFrame(rows, ROW), "record").collect()}
    rng.shuffle(rows)
    arrivals, log, progress = (str(tmp_path / x) for x in ("in", "log", "progress"))
    for n in range(5):
        spark.createDataFrame(rows[30 * n : 30 * n + 30], ROW).coalesce(1).write.parquet(f"{arrivals}/part={n}")
        stream = spark.readStream.schema(ROW).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(arrivals)
        T.retract(stream, log, progress).awaitTermination()  # each run starts from the checkpoint
    got = [(r.record, r.event_id) for r in T.view(spark, log).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    files = sum(len(f) for *_, f in os.walk(log))
    T.retract(stream, log, progress).awaitTermination()
    assert sum(len(f) for *_, f in os.walk(log)) == files


def test_ingest_reads_its_folders_and_sets_bad_rows_aside(spark, tmp_path):
    schema = "k long, v string"
    for n, rows in enumerate(([(1, "a"), (2, None), (1, "z")], [(1, "b"), (3, "c"), (4, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        I.ingest(stream, f"{tmp_path}/ledger", f"{tmp_path}/progress", "k", valid=F.col("v").isNotNull(), quarantine=f"{tmp_path}/aside", buckets=4).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/ledger").collect()) == [(1, "a"), (3, "c")]
    assert sorted(r.k for r in spark.read.schema(schema).parquet(f"{tmp_path}/aside").collect()) == [2, 4]
