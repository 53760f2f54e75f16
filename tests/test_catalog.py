"""Every registered query that has SQL gives the rows that DuckDB gives."""

import os

import pytest

from agentlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(value):
    if value is None or value != value:
        return "-"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(list(value)) if isinstance(value, (list, tuple)) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_module_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
