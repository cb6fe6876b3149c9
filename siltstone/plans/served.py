"""Queries served from a persisted index, and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scalar import micros
from siltstone.operators import inverted as V
from siltstone.operators import ledger as L
from siltstone.operators import search as Q
from siltstone.operators.shared import folder
from siltstone.plans.catalog import _HYBRID, _LIVE, _N, _PAGES, _QUESTION, _STARTS, _TF, _hybrid
from siltstone.plans.registry import ORACLES, QUERIES, read
from siltstone.streaming import ingest as I
from siltstone.streaming import retract as T

_built: dict[tuple[str, str], V.Index] = {}


def served(sql: str):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("long").alias("doc"), F.lit(0).alias("version"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 5 == 0).alias("machine"), F.lit(False).alias("deleted"))


def index_of(spark: SparkSession, sf_dir: str) -> V.Index:
    """The index of a folder's documents, built by the first query of a session that asks it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        index = V.Index(folder(spark, "index"))
        V.apply(index, _pages(spark, sf_dir), "whole")
        _built[key] = index
    return _built[key]


_PLAIN = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
_SCORED = f"""c AS (SELECT *, {_N.format('b', 'the')} AS b1, {_STARTS.format('b', 'an')} AS b2, {_N.format('h', 'the')} AS h1, {_STARTS.format('h', 'an')} AS h2 FROM (SELECT *, {_PLAIN.format('text')} AS b, {_PLAIN.format('title')} AS h FROM p))
SELECT doc_id, exact, score FROM (SELECT doc_id, lower(trim(title)) = 'the an*' AS exact, round((4 * (h1 + h2) / (1.0::DOUBLE + h1 + h2) + (b1 + b2) / (1.0::DOUBLE + b1 + b2)) / (1000 + least(length(text), 1000)) * CASE WHEN machine THEN 0.5::DOUBLE ELSE 1 END, 12) AS score
 FROM c WHERE b1 + h1 > 0 AND b2 + h2 > 0) ORDER BY exact DESC, score DESC, doc_id LIMIT 20"""


def _literal(spark: SparkSession, index: V.Index) -> DataFrame:
    found = V.literal(spark, index, "the an*", 60).withColumn("score", F.round("score", 12))
    return found.orderBy(F.desc("exact"), F.desc("score"), "doc").limit(20).select(F.col("doc").alias("doc_id"), "exact", "score")


@served(f"WITH p AS ({_PAGES}), {_SCORED}")
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literal(spark, index_of(spark, sf_dir))


@served(rf"""WITH w AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents)
SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND starts_with(w[i + 1], 'an'))) AS n FROM w) WHERE n > 0""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a phrase of two words, the second one a prefix, stands in each document that has it."""
    found = V.postings(spark, index_of(spark, sf_dir), [("the", False), ("an", True)])
    at = lambda keep, name: F.flatten(F.collect_list(F.when(keep, F.col("body")))).alias(name)
    docs = found.groupBy("doc").agg(at(F.col("term") == "the", "a"), at(F.startswith("term", F.lit("an")), "b"))
    return docs.select(F.col("doc").alias("doc_id"), V._starts([F.col("a"), F.col("b")]).cast("long").alias("n")).where("n > 0")


@served(f"""WITH w AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents), c AS (SELECT doc_id, (({_STARTS.format('w', 'decid')} + {_STARTS.format('w', 'decision')}) > 0)::INT + ({_STARTS.format('w', 'licens')} > 0)::INT
 + ({_STARTS.format('w', 'thing')} > 0)::INT + ({_STARTS.format('w', 'passag')} > 0)::INT AS covered FROM w)
SELECT doc_id, covered, round(covered / 4, 6) AS coverage FROM c WHERE covered >= 1""")
def search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, need = Q.relaxed_terms(_QUESTION)
    assert (len(terms), need) == (4, 3)
    found = V.relaxed(spark, index_of(spark, sf_dir), terms, need - 2)
    return found.select(F.col("doc").alias("doc_id"), "covered", F.round("coverage", 6).alias("coverage"))


#: A question of three words that documents hold together, so the rule's own share is met.
_ASKED = "Which license version was released?"


@served(f"""WITH w AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents), c AS (SELECT doc_id, ({_STARTS.format('w', 'licens')} > 0)::INT + ({_STARTS.format('w', 'version')} > 0)::INT + ({_STARTS.format('w', 'releas')} > 0)::INT AS covered FROM w)
SELECT doc_id, covered, covered / 3::DOUBLE AS coverage FROM c WHERE covered >= ceil(3 * 0.6)""")
def search_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, need = Q.relaxed_terms(_ASKED)
    return V.relaxed(spark, index_of(spark, sf_dir), terms, need).withColumnRenamed("doc", "doc_id")


_BM25 = rf"""w AS (SELECT doc_id, {_PLAIN.format('text')} AS w, {_PLAIN.format('title')} AS h FROM p), c AS (SELECT doc_id, (len(w) + 4 * len(h))::DOUBLE AS n, {_TF.format('the')} AS a, {_TF.format('license')} AS b FROM w),
 s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM c)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE a + b > 0"""


@served(f"WITH p AS ({_PAGES}), {_BM25}")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bm25(spark, index_of(spark, sf_dir), ["the", "license"]).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@served(_HYBRID)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.postings(spark, index_of(spark, sf_dir), [("the", False)])
    words = found.select(F.col("doc").alias("id"), F.size("body").alias("n")).where("n > 0")
    return _hybrid(lambda name: read(spark, sf_dir, name), words)


_CHANGED = """SELECT doc_id, lang, CASE WHEN doc_id % 7 = 1 THEN upper(text) || ' the license' ELSE text END AS text, CASE WHEN doc_id % 7 = 1 THEN 'the notice' ELSE split_part(text, chr(10), 1) END AS title, doc_id % 5 = 0 AS machine FROM documents WHERE doc_id % 9 > 0 OR doc_id % 7 = 1"""


def _kept(spark: SparkSession, sf_dir: str, compact: bool) -> V.Index:
    """An index kept by a stream of three batches: all documents, then changes and erasures, then what comes back."""
    pages, run = _pages(spark, sf_dir), folder(spark, "kept")
    changed = pages.where("doc % 7 = 1").withColumns({"title": F.lit("the notice"), "body": F.concat(F.upper("body"), F.lit(" the license"))})
    batches = [pages, pages.where("doc % 9 = 0").withColumn("deleted", F.lit(True)).unionByName(changed.where("doc % 9 > 0")), changed.where("doc % 9 = 0")]
    index = V.Index(f"{run}/index")
    for n, batch in enumerate(batches):
        batch.withColumn("version", F.lit(n)).write.parquet(f"{run}/arrivals/batch={n}")
        stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{run}/arrivals")
        V.maintain(stream, index, f"{run}/progress").awaitTermination()
    if compact:
        V.compacted(spark, index)
    return index


@served(f"WITH p AS ({_CHANGED}), {_SCORED}")
def index_kept_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literal(spark, _kept(spark, sf_dir, False))


@served(f"WITH p AS ({_CHANGED}), {_BM25}")
def index_compacted_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bm25(spark, _kept(spark, sf_dir, True), ["the", "license"]).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@served("SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, read as a stream of files and accepted into a ledger once each."""
    run = folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    I.ingest(I.arrivals(spark, f"{sf_dir}/[e]vents.parquet", schema), f"{run}/ledger", f"{run}/progress", "event_id").awaitTermination()
    return spark.read.parquet(f"{run}/ledger").select("event_id", "user_id", "event_type")


@served("SELECT event_id, user_id, 'held' AS state FROM events WHERE value IS NOT NULL AND event_type <> 'error' UNION ALL SELECT event_id, user_id, 'quarantined' FROM events WHERE value IS NULL OR event_type = 'error'")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't fit go aside, batch by batch; the others are held."""
    run = folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    fit = F.col("value").isNotNull() & (F.col("event_type") != "error")
    I.ingest(I.arrivals(spark, f"{sf_dir}/[e]vents.parquet", schema), f"{run}/ledger", f"{run}/progress", "event_id", valid=fit, quarantine=f"{run}/aside").awaitTermination()
    held = spark.read.parquet(f"{run}/ledger").select("event_id", "user_id", F.lit("held").alias("state"))
    return held.unionByName(spark.read.schema(schema).parquet(f"{run}/aside").select("event_id", "user_id", F.lit("quarantined").alias("state")))


@served(f"{_LIVE} SELECT record, event_id FROM live")
def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows of a stream that brings the events in six shuffled batches, tombstones before and behind their rows."""
    run = folder(spark, "retract")
    rows = L.from_events(read(spark, sf_dir, "events")).select("event_id", "accepted_at", "record", "deleted")
    rows.repartition(6, F.xxhash64("event_id")).write.parquet(f"{run}/arrivals")
    stream = I.arrivals(spark, f"{run}/arrivals", rows.schema, files=1)
    T.retract(stream, f"{run}/log", f"{run}/progress").awaitTermination()
    return T.view(spark, f"{run}/log")


@served("""WITH c AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS starts, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, starts, n FROM c WHERE starts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and user of a stream, written when the watermark has passed the day's end."""
    run = folder(spark, "windows")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = I.arrivals(spark, f"{sf_dir}/[e]vents.parquet", schema).withColumn("ts", F.timestamp_micros(micros(F.col("ts"))))  # watermarks ask for instants
    starts = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(window.start))")
    counts = I.windowed(rows, "ts", "user_id", "1 day", "2 hours").select("user_id", starts.alias("starts"), "n")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{run}/out")
