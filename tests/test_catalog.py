"""Every registered query of the library against its SQL, on a small table."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from helixframe import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    rows = got.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=key) == sorted(want.fetchall(), key=key)
