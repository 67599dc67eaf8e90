"""Every registered query that has SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from cirrusgrid import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.5g}") if abs(v) > 1e-9 else 0.0
    return None if v is None else str(v)[:19]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_duckdb(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
    found = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(normal(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    assert len(got) == len(want)
    # Rows are paired by what isn't a measurement, and by measurements only among those that share it.
    key = lambda row: ([str(x) for x in row if not isinstance(x, float)], [x for x in row if isinstance(x, float)])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-4, abs=2e-5)) for x, y in zip(a, b)), (a, b)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
