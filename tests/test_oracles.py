"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from ocellus.plans import basics, batch, cells, geometry, guidance, records, statistics, streams, tables, tumours  # noqa: F401
from ocellus.plans.registry import ORACLES, QUERIES
from ocellus.sources.adapters import BASE


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(f"{float(v):.9g}") + 0.0
    return str(v)


def rows(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
