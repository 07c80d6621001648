"""Every registered query runs; those with a SQL check agree with DuckDB on whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def canonical(columns, rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "<null>"
        return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


# slow fits run once, in test_ml
NAMES = [n for n in entry.queries() if n[:3] not in ("i24", "i25", "i26", "i27")]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == want_types
    assert canonical(df.columns, rows) == canonical(rel.columns, rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
