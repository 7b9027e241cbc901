"""Registered queries against DuckDB over the smallest tables."""

import os

import pytest

from nearfield.plans import queries

DIR = os.environ.get("NEARFIELD_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "shape", ()):
        return str([plain(y) for y in x])
    if isinstance(x, bool) or isinstance(x, (int, str)):
        return str(x)
    if hasattr(x, "as_integer_ratio"):
        return f"{float(x):.6g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    a = sorted(tuple(plain(v) if not isinstance(v, int) or isinstance(v, bool) else plain(float(v)) for v in r) for r in got.select(*cols).collect())
    b = sorted(tuple(plain(v) if not isinstance(v, int) or isinstance(v, bool) else plain(float(v)) for v in r) for r in want.project(quoted).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
