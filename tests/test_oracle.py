"""Every catalog query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vertexloom import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
NAMES = sorted(catalog.ORACLES)


def cell(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    rows = sorted(tuple(str(cell(r[c])) for c in cols) for r in got.collect())
    assert rows == sorted(tuple(str(cell(r[i])) for i in order) for r in want.fetchall())


def test_registered_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
