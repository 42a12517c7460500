"""The queries with SQL give the rows DuckDB gives on the same tables."""

from pathlib import Path

import duckdb
import pytest

from partloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(cur.fetchall())
