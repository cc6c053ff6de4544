"""Every query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest
from conftest import SF, TABLES

from folioflow.plans import registered as plain


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return c


def plain_value(x):
    if isinstance(x, (list, dict, tuple)):
        return repr(x)
    if pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain_value(x) for x in r]) for r in frame[columns].to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(plain.SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(plain.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(plain.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plain.QUERIES) - set(plain.SQL)))
def test_runs(spark, name):
    assert plain.QUERIES[name](spark, SF).count() > 0
