"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
Q, O = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", [n for n in Q if n in O])
def test_same_rows(spark, con, name):
    df = Q[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(O[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((str([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall()))
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in Q if n not in O and n != "pipeline" and not n.startswith("op")])
def test_runs(spark, name):
    assert Q[name](spark, SF).limit(1).count() <= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
