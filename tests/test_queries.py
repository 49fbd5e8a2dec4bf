"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessella import plans


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def key(row):
    return tuple((x is None, str(type(x).__name__ if isinstance(x, bool) else ""), str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    df = plans.QUERIES[name](spark, sf_dir)
    want = db.execute(plans.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert sorted(df.columns) == columns
    assert len(got) == len(rows)
    for a, b in zip(got, rows):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and y is not None and x == pytest.approx(float(y), rel=1e-6, abs=1e-6)), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
