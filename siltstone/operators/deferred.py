"""Inputs that were put off, and which of them to look at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recheck(queue: DataFrame, grants: DataFrame, events: DataFrame, binding: str, allowed: Column, after: str | int | None = None, page: int = 100) -> tuple[DataFrame, DataFrame]:
    """(ready, queue): a page of inputs that may be read now, and the queue with what was found out.

    ``queue``: event_id, source, checked_revision, checked_binding.  ``grants``: source, revision and what ``allowed`` asks.
    An input is looked at again where its source's revision or the model's binding is another than when it was put off.
    Those of a source that still denies are noted as looked at; of the others the next page goes on, behind ``after`` and,
    where nothing is behind it, from the start.  An input whose event is gone, or belongs to another source now
    (``events``: event_id, source), is an error."""
    g = grants.select(F.col("source"), F.col("revision"), F.coalesce(allowed, F.lit(False)).alias("open"))
    met = queue.join(g, "source", "left")
    changed = ~F.col("checked_revision").eqNullSafe(F.coalesce("revision", F.lit(0))) | ~F.col("checked_binding").eqNullSafe(F.lit(binding))
    denied = changed & F.col("revision").isNotNull() & ~F.col("open")
    wrong = met.where(changed).join(events.select("event_id", F.col("source").alias("own")), "event_id", "left")
    odd = wrong.join(events.select("event_id"), "event_id", "left_anti").select("event_id").unionByName(wrong.where(F.col("own").isNotNull() & ~F.col("own").eqNullSafe(F.col("source"))).select("event_id"))
    if not odd.isEmpty():
        raise ValueError("a deferred input's event is missing or belongs to another source")
    free = met.where(changed & ~F.coalesce(denied, F.lit(False)))
    behind = free if after is None else free.where(F.col("event_id") > F.lit(after))
    ready = (free if after is not None and behind.isEmpty() else behind).orderBy("event_id").limit(page).select("event_id", "source")
    noted = met.select(
        "event_id", "source", F.when(denied, F.col("revision")).otherwise(F.col("checked_revision")).alias("checked_revision"), F.when(denied, F.lit(binding)).otherwise(F.col("checked_binding")).alias("checked_binding"),
    )
    return ready, noted
