"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from rowtide import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if x is None or str(x) in ("nan", "<NA>", "NaT") else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLES:
        assert len(got)
        return
    want = con.execute(plans.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
