"""Every registered query against its SQL on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphlift.plans import registry
from graphlift.plans.sample import FILES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")

QUERIES, SQL = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in FILES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in names]).collect())
    assert got == sorted(str(tuple(r)) for r in cursor.fetchall())


def test_entry(spark):
    assert {r.segment: r.n for r in entry.entry(spark).collect()} == {
        "AUTOMOBILE": 226, "BUILDING": 342, "FURNITURE": 403, "HOUSEHOLD": 224, "MACHINERY": 305,
    }


def test_every_query_of_the_library_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)
