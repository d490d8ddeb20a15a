"""Every registered query of the core runs at the smallest scale, and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

from leafmill.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert rows
    if name in queries.ORACLES:
        got = db.execute(queries.ORACLES[name])
        names = [d[0] for d in got.description]
        want = [tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
