"""Exact duplicates by an extendible-hash index on shared files, with DataFrame
functions only.

Every text has a 64-bit key.  The index has one record a key: its rows, and the
row that stays.  A directory leads from the first bits of a key to its bucket:
it begins with one bucket and doubles while a bucket has more than ``capacity``
keys, so buckets that fit stay whole and only those that don't are split.  Each
owner task holds a range of keys, which are its buckets, and writes them to the
shared folder.  Keys with one row are done.  For the others the owners compare
bytes: the texts of a key are folded where they lie, equal ones to one, and what
is left under a key is its chain.  A chain of several texts is a collision, and
its rows are told apart by their texts.

Null texts count as empty; texts are equal when their bytes are, whatever their
length.  Of equal rows that with the largest id stays, one of them if several
have it, and a null id is the smallest.  Rows may repeat: each counts, one
stays.  Other columns are ignored, and an empty table gives an empty result.

A text that a third of the rows have costs one record a map task, as keys and
texts are summed before they are shuffled, and rows meet what is said of a hot
key by broadcast.  No text is shuffled but those whose key has several rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import hot_join, parallelism, scratch, stored

BITS = 64
#: Keys that a bucket holds at least, before it may be split.
CAPACITY = 4096
#: Doublings of the directory that one count of the keys is good for.
DOUBLINGS = 4
#: Slots of a directory that is broadcast, at most (24 bytes each).
SLOTS = 1 << 21

ORACLE = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


class Index(NamedTuple):
    """``records`` by bucket in ``path``: key, w (rows), keep_id, keep_row, owner, bucket.  ``slots``: slot, bucket, owner,
    a row for each value of a key's first ``depth`` bits."""

    path: str
    depth: int
    slots: DataFrame
    records: DataFrame


def key_of(text: Column, bits: int = BITS) -> Column:
    """The first ``bits`` bits of a hash; fewer than 64 make collisions, for tests."""
    return F.xxhash64(text) if bits == BITS else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), BITS - bits), BITS - bits)


def first_bits(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(depth, prefix) of every bucket, in the order of keys.  ``keys`` has each key once.

    A full bucket is split in two until its halves fit or its keys have no further bit.  The driver holds no
    more than the directory and 16 counts for each full bucket, of which there are fewer than keys / capacity."""
    spark, depth, full, buckets = keys.sparkSession, 0, [0], []
    while full:
        ahead = min(DOUBLINGS, bits - depth)
        under = keys
        if depth:
            marks = spark.createDataFrame([(p,) for p in full], "mark long")
            under = keys.join(F.broadcast(marks), first_bits(F.col("key"), depth) == F.col("mark"), "left_semi")
        counts = {r[0]: r[1] for r in under.groupBy(first_bits(F.col("key"), depth + ahead).alias("p")).count().collect()}
        level, depth = depth, depth + ahead
        waiting, full = [(level, p) for p in full], []
        while waiting:
            d, p = waiting.pop()
            held = sum(counts.get(q, 0) for q in range(p << (depth - d), (p + 1) << (depth - d)))
            if held <= capacity or d == bits:
                buckets.append((d, p))
            elif d == depth:
                full.append(p)
            else:
                waiting += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
    return sorted(buckets, key=lambda b: b[1] << (bits - b[0]))


def slots_of(spark: SparkSession, buckets: list[tuple[int, int]], owners: int) -> tuple[int, DataFrame]:
    """The directory's depth and slots.  Owners take runs of buckets, which are ranges of keys."""
    depth = max(d for d, _ in buckets)
    rows = [(i, d, p, i * owners // len(buckets)) for i, (d, p) in enumerate(buckets)]
    spread = F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")
    slots = spark.createDataFrame(rows, "bucket int, depth int, prefix long, owner int").select(F.explode(spread).alias("slot"), "bucket", "owner")
    return depth, F.broadcast(slots) if 1 << depth <= SLOTS else slots


def to_owners(rows: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """``rows`` with ``bucket`` and ``owner``, each in the task that owns its key."""
    placed = rows.withColumn("slot", first_bits(F.col("key"), depth)).join(slots, "slot").drop("slot")
    return placed.repartitionById(parallelism(rows.sparkSession), F.col("owner"))


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, key, sha, row for each document, written: ``row`` tells rows apart and stays as written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(text, bits).alias("key"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-entries")


def index(found: DataFrame, capacity: int | None = None, bits: int = BITS) -> Index | None:
    """The index of ``entries``; none of an empty table.  Unless told, a bucket holds 4096 keys or a
    quarter of an owner's share, whichever is more, so there are about eight buckets an owner at most."""
    spark = found.sparkSession
    stays = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))
    keys = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.max("doc_id").alias("keep_id"), stays.alias("keep_row")), "exact-keys")
    n = keys.count()
    if not n:
        return None
    owners = parallelism(spark)
    buckets = directory(keys, capacity or max(CAPACITY, -(-n // (4 * owners))), bits)
    depth, slots = slots_of(spark, buckets, owners)
    path = scratch(spark, "exact-index")
    to_owners(keys, depth, slots).sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
    return Index(path, depth, slots, spark.read.schema(f"{_RECORD}, bucket int").parquet(path))


_RECORD = "key long, w long, keep_id long, keep_row long, owner int"


def collisions(docs: DataFrame, several: DataFrame, total: int, at: Index, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Keys whose chain has more than one text, with its length.  ``several``: key and rows (``w``) of the keys to look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(key_of(text, bits).alias("key"), text.alias("text"))
    folded = hot_join(texts, several.select("key", "w"), "key", "w", total).groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"))
    return to_owners(folded, at.depth, at.slots).groupBy("owner", "key").agg(F.count(F.lit(1)).alias("chain")).where("chain > 1").select("key", "chain")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha, collided for each row of ``docs``; ``collided`` where other texts have its key."""
    spark = docs.sparkSession
    found = entries(docs, id_col, text_col, bits)
    at = index(found, capacity, bits)
    if at is None:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, sha binary, collided boolean")
    several = stored(at.records.where("w > 1").drop("owner", "bucket"), "exact-several")
    total = found.count()
    clash = stored(collisions(docs, several, total, at, text_col, bits), "exact-collisions")

    def told(rows: DataFrame, collided: bool) -> DataFrame:
        size = F.coalesce("size", F.lit(1)).cast("long")
        return rows.select("doc_id", F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), size.alias("group_size"), (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"), "sha", F.lit(collided).alias("collided"))

    # a key without a record in ``several`` has one row, so no unmatched key is hot
    known = several.select("key", "w", F.col("w").alias("size"), "keep_id", "keep_row")
    if not clash.count():
        return told(hot_join(found, known, "key", "w", total, "left"), False)
    weights = clash.select("key").join(several.select("key", "w"), "key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(text, bits).alias("key"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = stored(hot_join(texts, weights, "key", "w", total).drop("key"), "exact-chains")
    stays = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))
    chains = stored(rows.groupBy("text").agg(F.count(F.lit(1)).alias("w"), F.max("doc_id").alias("keep_id"), stays.alias("keep_row")).withColumn("size", F.col("w")), "exact-texts")
    free = hot_join(found, known.join(clash.select("key"), "key", "left_anti"), "key", "w", total, "left").join(clash.select("key"), "key", "left_anti")
    return told(free, False).unionByName(told(hot_join(rows, chains, "text", "w", rows.count()), True))
