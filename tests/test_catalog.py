"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from voidloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return f"{x:.6g}" if isinstance(x, float) and math.isfinite(x) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, sf_dir)
    told = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, told.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
