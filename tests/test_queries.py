"""Every registered query runs; those with SQL agree with DuckDB on the same tables."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from fathomline.plans import catalog


def _value(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [_value(x) for x in v]
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def _rows(columns, rows):
    order = sorted(columns)
    return sorted(str([_value(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, rows) == _rows(columns, found.fetchall())
