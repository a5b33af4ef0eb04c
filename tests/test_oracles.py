"""Every registered query against its SQL in DuckDB, on the smallest tables."""
import datetime
from pathlib import Path

import duckdb
import pytest

from oddsmill.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def one(x):
        if isinstance(x, datetime.datetime):
            return str(x.replace(tzinfo=None))
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DATA)
    if name not in registry.oracle_sql():  # fits: tests/test_fits.py holds them against what made the data
        assert len(got.collect()) >= 0
        return
    columns = sorted(got.columns)
    expected = con.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    rows = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM expected").fetchall()
    assert plain(got.select(*columns).collect()) == plain(rows)
