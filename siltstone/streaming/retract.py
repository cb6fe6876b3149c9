"""Retraction over a stream: rows live until a tombstone of their record that is later than they are.

State is one instant a record, its latest tombstone, however many rows the record
has; the instants of a group of records lie together.  A row that comes after it is passed on; one that comes before is not, in
whatever order they arrive.  When a tombstone moves the instant, a cutoff is
passed on.  The log of what was passed on is the view: its rows beyond their
record's greatest cutoff live.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siltstone.functions.scalar import micros

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "record long, event_id long, at long, cutoff boolean"


#: Groups of records that have a state each, and what a record's state is.
SHARES = 512
_LAST = np.dtype([("record", "<i8"), ("at", "<i8"), ("event_id", "<i8")])


class Cutoffs(StatefulProcessor):
    """Rows later than their record's latest tombstone, and a row for each tombstone that moves it.  A group holds many
    records, whose instants are one sorted array, so a batch asks for a state a group and not a record.  Rows without a
    record are no one's, and pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for frame in rows:
                yield frame.loc[~frame["deleted"], ["record", "event_id", "at"]].assign(cutoff=False)
            return
        known = pd.DataFrame(np.frombuffer(self.last.get()[0], _LAST) if self.last.exists() else np.empty(0, _LAST))
        order = ["record", "at", "event_id"]
        waiting, newest = [], known.assign(cutoff=False)
        for frame in rows:
            gone = frame.loc[frame["deleted"], order].assign(cutoff=True)
            if len(gone):  # of equal ones the known one is last, and stays
                newest = pd.concat([newest, gone]).sort_values([*order, "cutoff"], ascending=[True, True, True, False]).drop_duplicates("record", keep="last")
            waiting.append(frame.loc[~frame["deleted"], ["record", "event_id", "at"]])
        if newest["cutoff"].any():
            packed = np.empty(len(newest), _LAST)
            for c in order:
                packed[c] = newest[c].to_numpy()
            self.last.update((packed.tobytes(),))
            yield newest.loc[newest["cutoff"], ["record", "event_id", "at", "cutoff"]]
        records, at, event_id = (newest[c].to_numpy() for c in order)
        for frame in waiting:
            if len(records):
                i = np.searchsorted(records, frame["record"].to_numpy()).clip(max=len(records) - 1)
                later = (frame["at"] > at[i]) | ((frame["at"] == at[i]) & (frame["event_id"] > event_id[i]))
                frame = frame[(frame["record"] != records[i]) | later]
            if len(frame):
                yield frame.assign(cutoff=False)

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """CHANGES of a stream of ledger rows: event_id, accepted_at, record, deleted."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.select("record", "event_id", micros(F.col("accepted_at")).alias("at"), "deleted")
    share = F.when(F.col("record").isNull(), -1).otherwise(F.pmod(F.xxhash64("record"), F.lit(SHARES))).cast("int")
    return rows.withColumn("share", share).groupBy("share").transformWithStateInPandas(Cutoffs(), CHANGES, "Append", "None")


def retract(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of a stream below ``log``, a folder a batch; a batch that runs again replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return changes(stream).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view(spark: SparkSession, log: str) -> DataFrame:
    """record, event_id: what lives after the batches so far.  A cutoff a record is found by an aggregate and met by a
    join, so a record with very many rows is no hot task while cutoffs are broadcast."""
    rows = spark.read.schema(CHANGES + ", batch int").parquet(log)
    cut = rows.where("cutoff").groupBy("record").agg(F.max(F.struct("at", "event_id")).alias("cut"))
    return rows.where("NOT cutoff").join(cut, "record", "left").where(F.col("cut").isNull() | (F.struct("at", "event_id") > F.col("cut"))).select("record", "event_id")
