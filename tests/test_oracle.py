"""Every registered query with SQL against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from apiscope.queries import catalog

SF = "/root/testdata/sf0.001"
#: the library's own queries; those of the corpus operators have tests of their own
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([rounded(r[n]) for n in names]) for r in df.collect())
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = sorted(repr([rounded(row[i]) for i in at]) for row in cur.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and {r.category for r in rows} <= {"documented", "zombie", "shadow"}
