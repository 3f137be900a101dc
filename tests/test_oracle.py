"""Every registered query against its SQL, on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ORACLE = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE:
        assert rows
        return
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, rows) == rows_of(columns, want.fetchall())


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert row["test"] == "Kruskal-Wallis Test"
    assert row["decision"] in ("H0 retained", "H1 accepted")
