"""Every query of the entry module that has SQL, against DuckDB over the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    return int(value) if isinstance(value, (int, float)) and float(value).is_integer() else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda data: sorted((tuple(map(plain, r)) for r in data), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
