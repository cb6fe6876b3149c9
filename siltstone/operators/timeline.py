"""Bounded, ordered reads of occurrences."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_window(column: Column, day: str) -> Column:
    """The half-open UTC day; an impossible date raises."""
    first = date.fromisoformat(day)
    return (column >= F.to_timestamp_ntz(F.lit(f"{first} 00:00:00"))) & (column < F.to_timestamp_ntz(F.lit(f"{first + timedelta(days=1)} 00:00:00")))


def page(rows: DataFrame, at: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """A page in (at, key) order behind ``after``."""
    if after is not None:
        rows = rows.where(F.struct(F.col(at), F.col(key)) > F.struct(F.to_timestamp_ntz(F.lit(after[0])), F.lit(after[1]).cast("long")))
    return rows.orderBy(at, key).limit(limit)
