"""Core queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from docweave.plans import oracle, queries

D = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.skipif(not os.path.exists(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    res = con.execute(SQL[name])
    names = [c[0] for c in res.description]
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in res.fetchall()), key=repr)
    assert sorted(names) == cols and got == want
