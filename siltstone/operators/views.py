"""Views by group that are recomputed where their input changed, and there alone.

A group's basis is a fingerprint of its rows as a multiset: their number, two
sums and a combination of 64-bit hashes.  It is an aggregate, so a hot group
folds before it is shuffled, and no row order plays a part.  A refresh compares
bases, computes the groups that differ or have expired, and keeps the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.shared import written


def basis(rows: DataFrame, group: str, *inputs: str) -> DataFrame:
    """group, basis: equal where a group's rows are, whatever their order."""
    a, b = F.xxhash64(*inputs), F.xxhash64(F.lit(1), *inputs)
    summed = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(38,0)")).alias("s"), F.sum(b.cast("decimal(38,0)")).alias("t"), F.bit_xor(F.xxhash64(a, b)).alias("x"))
    return summed.select(group, F.sha2(F.concat_ws(":", "n", "s", "t", "x").cast("binary"), 256).alias("basis"))


def built(rows: DataFrame, group: str, inputs: tuple[str, ...], compute: Callable[[DataFrame], DataFrame], expires: Column | None = None) -> DataFrame:
    """The whole view: what ``compute`` makes of the rows (a row a group), its basis, and until when it holds."""
    until = expires if expires is not None else F.lit(None).cast("timestamp_ntz")
    return compute(rows).join(basis(rows, group, *inputs), group).withColumn("expires_at", until)


def refreshed(view: DataFrame, rows: DataFrame, group: str, inputs: tuple[str, ...], compute: Callable[[DataFrame], DataFrame], now: Column, expires: Column | None = None) -> DataFrame:
    """The view of ``rows`` with column ``renewed``: true where it was computed again, because its basis changed or its time
    had come.  Groups that are gone leave the view.  Only rows of renewed groups go into ``compute``."""
    fresh = written(basis(rows, group, *inputs), "basis")
    held = view.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    kept = held.join(fresh, [group, "basis"], "left_semi")
    stale = fresh.join(kept.select(group), group, "left_anti").select(group)
    again = compute(rows.join(stale, group, "left_semi")).join(fresh, group).withColumn("expires_at", expires if expires is not None else F.lit(None).cast("timestamp_ntz"))
    return kept.withColumn("renewed", F.lit(False)).unionByName(again.withColumn("renewed", F.lit(True)))
