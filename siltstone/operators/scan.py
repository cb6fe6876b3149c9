"""Running values over one long order: numbers, priors, running sums and maxima, as-of joins.

A window without a partition is one task, and a window over a hot key nearly so.
Here rows are dealt into ranges of (group, order) and written once, so a hot
group lies in many ranges.  Each range folds its own rows by a window; of each
range only what it says of its last group, one row, goes on to the ranges behind.
Those rows are as many as ranges, whatever the table's size, and are broadcast.
The ranges are read from what was written: planned twice, two range exchanges
need not cut alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

RANGE = "_range"


def ranged(rows: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_range``, rising with the order (nulls first), in the shared folder."""
    n = parts or rows.sparkSession.sparkContext.defaultParallelism
    return written(rows.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()), "ranged")


def _fold(how: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how](value)


def _both(how: str, carried: Column, own: Column) -> Column:
    if how == "sum":
        return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(carried + own)
    return {"max": F.greatest, "min": F.least, "last": lambda c, o: F.coalesce(o, c)}[how](carried, own)


def running(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], *wanted: tuple[str, str, Column], upto: int = 0) -> DataFrame:
    """Adds, for each (name, how, value) wanted, the sum, max, min or last value that is not null over a group's rows up to
    this one (``upto`` 0) or the one before it (-1); null where there is none.

    ``rows`` come from ``ranged`` by (*group, *order), and the order tells all rows of a group apart.  Null groups are a group."""
    near = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    here = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    # what each range says of its last group
    last = F.broadcast(rows.groupBy(F.col(RANGE).alias("_scan_r")).agg(F.max(here).alias("_scan_g")))
    tail = rows.join(last, (F.col(RANGE) == F.col("_scan_r")) & here.eqNullSafe(F.col("_scan_g")))
    said = [(F.max_by(v, F.when(v.isNotNull(), F.struct(*order))) if how == "last" else _fold(how, v)).alias(f"_{name}") for name, how, v in wanted]
    ends = tail.groupBy("_scan_r", "_scan_g").agg(*said)
    through = Window.partitionBy("_scan_g").orderBy("_scan_r")
    ends = ends.select("_scan_r", "_scan_g", *(_fold(how, F.col(f"_{name}")).over(through).alias(f"_{name}") for name, how, _ in wanted))
    carry = F.broadcast(ends.withColumn("_scan_r", F.lead("_scan_r").over(Window.orderBy("_scan_r"))).where(F.col("_scan_r").isNotNull()))
    own = rows.select("*", *(_fold(how, v).over(near).alias(f"_own_{name}") for name, how, v in wanted))
    met = own.join(carry, (F.col(RANGE) == F.col("_scan_r")) & here.eqNullSafe(F.col("_scan_g")), "left")
    return met.select(*rows.columns, *(_both(how, F.col(f"_{name}"), F.col(f"_own_{name}")).alias(name) for name, how, _ in wanted))


def numbered(rows: DataFrame, *order: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """Adds ``number``: dense, in order."""
    cut = ranged(rows, *order, parts=parts)
    return running(cut, (), order, ("number", "sum", F.lit(1).cast("long"))).withColumn("number", F.col("number") + (start - 1)).drop(RANGE)


def prior(rows: DataFrame, name: str, value: str, *order: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the last ``value`` before this row in the order of the whole table."""
    return running(ranged(rows, *order, parts=parts), (), order, (name, "last", F.col(value)), upto=-1).drop(RANGE)


def as_of(asked: DataFrame, history: DataFrame, key: str, at: str, state: tuple[str, ...], sequence: str, counted: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Each row of ``asked`` (key, at, and whatever else) with the state of its key as of then: the columns ``state`` of
    the history row with the greatest (at, sequence) not after it, null if there is none, in ``state.*``; ``n_known``, the
    history rows up to then; and with ``counted`` (key, at) ``n_counted``, how many of its rows lie up to then.

    One pass over the union of the tables, so as many cutoffs as there are cost no more than one; a hot key is cut by time."""
    carried = F.struct(*(F.col(c) for c in state))
    rows = history.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(sequence).cast("long").alias("_seq"), carried.alias("state"), F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("_asked"))
    if counted is not None:
        rows = rows.unionByName(counted.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_seq")), allowMissingColumns=True)
    rows = rows.unionByName(asked.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(2).alias("_side"), F.monotonically_increasing_id().alias("_seq"), F.struct("*").alias("_asked")), allowMissingColumns=True)
    order = ("_at", "_side", "_seq")
    one = lambda side: F.when(F.col("_side") == side, 1).otherwise(0).cast("long")
    found = running(ranged(rows, "_key", *order, parts=parts), ("_key",), order, ("known", "last", F.col("state")), ("n_known", "sum", one(0)), ("n_counted", "sum", one(1)))
    out = found.where("_side = 2").select("_asked.*", F.col("known").alias("state"), "n_known", "n_counted")
    return out if counted is not None else out.drop("n_counted")
