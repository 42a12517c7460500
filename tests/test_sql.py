"""Every core query with SQL gives the rows DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from partloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, small, name):
    df = catalogue.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got == want


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
