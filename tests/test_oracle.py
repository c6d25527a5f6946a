"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from rondo.plans import load_all
from rondo.plans.registry import QUERIES, SQL

load_all()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def neutral(rows):
    def v(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else repr(x)

    return sorted(tuple(map(v, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = neutral(tuple(r[c] for c in cols) for r in got.collect())
    b = neutral(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
