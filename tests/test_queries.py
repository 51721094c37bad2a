"""Every query against its SQL in DuckDB, as the driver compares them."""

import glob
from pathlib import Path

import duckdb
import pytest

from corvid.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert df.count() > 0
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
