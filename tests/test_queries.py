import glob
import os

import duckdb
import pytest

from lumenframe.plans.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def rows(found):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in found)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*cols).collect())
    if name in ORACLES:
        assert got == rows(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
