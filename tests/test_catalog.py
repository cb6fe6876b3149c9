"""Each registered query of the reference's operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from siltstone.plans import catalog, more, served, states, writes  # noqa: F401
from siltstone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if not isinstance(v, (list, np.ndarray)) and pd.isna(v):
            return ""
        number = isinstance(v, (int, float, np.number)) and not isinstance(v, bool)
        return repr(round(float(v), 6) + 0.0) if number else str(v)  # whole numbers are floats on one side where some are null

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(plain, r)) for r in frame[cols].astype(object).values.tolist())


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(found) == rows(duck.execute(ORACLES[name]).df())
    else:
        assert len(found)
