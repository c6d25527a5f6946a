"""Queries that SQL can say against their DuckDB twins."""

import duckdb
import pytest

from rondo.llm import queries


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name, sf):
    path = f"/root/testdata/sf{sf}"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/documents.parquet'")
    got = queries.QUERIES[name](spark, path)
    want = c.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    a = sorted((tuple(r[x] for x in cols) for r in got.collect()), key=key)
    assert a == sorted(want.project(", ".join(f'"{x}"' for x in cols)).fetchall(), key=key)
