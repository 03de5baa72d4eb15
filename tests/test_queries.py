"""Every query against its SQL in DuckDB, and the rest for rows."""

import math
import os

import duckdb
import pytest

from graphloom import plans
from graphloom.plans import catalog

plans.load()
#: Queries that may rightly find nothing in the generated tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    assert got or name in MAY_BE_EMPTY
    if name in catalog.SQL:
        found = duck.execute(catalog.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
