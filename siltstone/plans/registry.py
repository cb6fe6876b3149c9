"""The registered queries and, for each that SQL can express, DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a core of a table that is dealt out before it is used.
SMALL = 64 << 20
_SIZES: dict[tuple[str, str], tuple[int, int]] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  Texts in few small files, as one of a single row group, are dealt out first: what is asked of them may be
    dear.  Files and bytes are looked up once a session, without reading them."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    if name != "documents":
        return rows
    cores = spark.sparkContext.defaultParallelism
    key = spark.sparkContext.applicationId, path
    if key not in _SIZES:
        _SIZES[key] = tuple(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first())
    files, size = _SIZES[key]
    return rows.repartition(cores) if 1 < cores and files <= min(cores, 64) and size <= min(cores, 64) * SMALL else rows


def query(sql: str | None = None):
    """Register a function of a table reader under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
