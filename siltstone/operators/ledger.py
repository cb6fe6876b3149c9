"""The append-only ledger: liveness, versions, de-duplication, cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from siltstone.operators import scan


def from_events(events: DataFrame) -> DataFrame:
    """The driver's event stream as ledger rows: a record is a user's events of one
    kind, errors are tombstones, and sensitivity 3 lies outside the lattice."""
    return events.select(
        "event_id", F.col("ts").alias("accepted_at"), F.col("user_id").alias("record"), F.col("event_type").alias("kind"), "value", "props",
        (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_id") % 4 < 3, (F.col("event_id") % 4).cast("int")).alias("sensitivity"),
    )


ORDER = ("accepted_at", "event_id")


def live(ledger: DataFrame, *record: str) -> DataFrame:
    """Rows that are no tombstone and have no later tombstone of their record; a re-capture after a tombstone lives.
    Tombstones fold to one a record, and rows meet it without being sorted, so a record with very many rows is only a
    skewed side of a join: broadcast while cutoffs are few, and else cut by Spark at run time."""
    order = F.struct(*ORDER)
    cut = ledger.where("deleted").groupBy(*(F.col(r).alias(f"_k{i}") for i, r in enumerate(record))).agg(F.max(order).alias("_t"))
    same = reduce(lambda x, y: x & y, (F.col(r).eqNullSafe(F.col(f"_k{i}")) for i, r in enumerate(record)))
    met = ledger.where("NOT deleted").join(cut, same, "left").where(F.col("_t").isNull() | (order > F.col("_t")))
    return met.select(*ledger.columns)


def current(scoped: DataFrame, *record: str) -> DataFrame:
    """Latest row of each record, of the rows that a reader may see: scope first, then versions.  An aggregate, so rows
    fold before the shuffle and a hot record is no hot task."""
    return scoped.groupBy(*record).agg(F.max_by(F.struct(*scoped.columns), F.struct(*ORDER)).alias("r")).select("r.*")


def mirrored(ledger: DataFrame, *record: str) -> DataFrame:
    """What a source holds now: the latest version of each record, unless that is a tombstone."""
    return current(ledger, *record).where("not deleted")


def deduplicated(ledger: DataFrame, *key: str) -> DataFrame:
    """First row for each key in ledger order."""
    return ledger.groupBy(*key).agg(F.min_by("event_id", F.struct(*ORDER)).alias("event_id"), F.count(F.lit(1)).alias("n_seen"))


def accept(batch: DataFrame, ledger: DataFrame, *key: str) -> DataFrame:
    """Rows of a batch that the ledger does not hold yet, of equal ones the first in ledger order, or the smallest."""
    order = F.struct(*(c for c in ORDER if c in batch.columns), *(c for c in batch.columns if c not in ORDER and not isinstance(batch.schema[c].dataType, MapType)))
    once = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    return once.join(ledger.select(*key).distinct(), list(key), "left_anti")


def accepted(batch: DataFrame, ledger: DataFrame, suppressed: DataFrame, valid: Column, *key: str) -> DataFrame:
    """The batch with the outcome of each row: error where it is not valid, suppressed where its record is, duplicate
    where the ledger or an earlier row that was neither has its key, else stored.  The first row of a key is found by an
    aggregate, so a hot key folds before it is shuffled."""
    marked = batch.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    marked = marked.join(suppressed.distinct().withColumn("_s", F.lit(True)), suppressed.columns, "left").withColumn("_at", F.struct(*ORDER))
    first = marked.where("_ok AND _s IS NULL").groupBy(*key).agg(F.min("_at").alias("_first"))
    held = ledger.select(*key).distinct().withColumn("_h", F.lit(True))
    for other in (first, held):
        renamed = other.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), *(c for c in other.columns if c not in key))
        on = F.lit(True)
        for i, k in enumerate(key):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        marked = marked.join(renamed, on, "left").drop(*(f"_k{i}" for i in range(len(key))))
    outcome = F.when(~F.col("_ok"), "error").when(F.col("_s"), "suppressed").when(F.col("_h") | (F.col("_at") > F.col("_first")), "duplicate").otherwise("stored")
    return marked.withColumn("outcome", outcome).drop("_ok", "_s", "_h", "_at", "_first")


def replay(ledger: DataFrame, *record: str, kinds: tuple = (), since: str | None = None, only_live: bool = False) -> DataFrame:
    """Rows in ledger order by kind and time, all or those alive."""
    rows = live(ledger, *record) if only_live else ledger
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    rows = rows.where(F.col("accepted_at") >= F.to_timestamp_ntz(F.lit(since))) if since else rows
    return rows.orderBy(*ORDER)


def count_since(ledger: DataFrame, accepted_at: Column, event_id: int) -> DataFrame:
    """How many rows lie behind a cursor, and the cursor of the last row."""
    behind = F.struct(*ORDER) > F.struct(accepted_at, F.lit(event_id).cast("long"))
    return ledger.agg(F.count(F.when(behind, 1)).alias("n"), F.count(F.lit(1)).alias("total"), F.max(F.struct(*ORDER)).alias("last")).select("n", "total", "last.*")


def lookup(ledger: DataFrame, ids: DataFrame, *record: str) -> DataFrame:
    """The rows with these ids, and whether each is alive; only their records are read for tombstones."""
    own = ledger.join(ids, "event_id", "left_semi")
    rows = ledger.join(own.select(*record).distinct(), list(record), "left_semi")
    alive = live(rows, *record).select("event_id").withColumn("alive", F.lit(True))
    return own.join(alive, "event_id", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))


def upserted(index: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """The index with the batch's documents in place of older ones."""
    both = index.unionByName(batch)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.struct(version)).alias("r")).select("r.*")


def numbered(rows: DataFrame, *order: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """Adds ``number``: dense, in order (see ``scan``)."""
    return scan.numbered(rows, *order, start=start, parts=parts)


def integrity(history: DataFrame, states: DataFrame, key: str = "record") -> DataFrame:
    """(rule, n): entries of a history that break a rule.  ``history``: sequence, recorded_at, key, status.  ``states``:
    key, status.  The clock is that of the whole log: a step back from one key's entry to another's counts."""
    back = scan.prior(history.select("sequence", "recorded_at"), "prior", "recorded_at", "sequence").where("recorded_at < prior")
    last = history.groupBy(key).agg(F.max_by("status", "sequence").alias("last"))
    wrong = states.join(last, key).where(~F.col("status").eqNullSafe(F.col("last")))
    orphan = history.join(states, key, "left_anti")
    bare = states.join(history.select(key).distinct(), key, "left_anti")
    count = lambda rows, rule: rows.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    return count(back, "clock_back").unionByName(count(wrong, "state_differs")).unionByName(count(orphan, "orphan_entry")).unionByName(count(bare, "no_history"))


def read_since(ledger: DataFrame, accepted_at: Column, event_id: int, limit: int = 1000) -> DataFrame:
    """A page behind a cursor; the caller sees from limit + 1 rows that there is more."""
    return ledger.where(F.struct(*ORDER) > F.struct(accepted_at, F.lit(event_id).cast("long"))).orderBy(*ORDER).limit(limit)


def history(ledger: DataFrame, *record: str) -> DataFrame:
    """Latest row of each record and the number of its versions."""
    out = ledger.groupBy(*record).agg(F.max_by(F.struct(*ledger.columns), F.struct(*ORDER)).alias("r"), F.count(F.lit(1)).alias("versions"))
    return out.select("r.*", "versions")


def purge(ledger: DataFrame, selector: Column) -> DataFrame:
    """What a purge would take, by kind."""
    return ledger.where(selector).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record").alias("n_records"))
