"""Every registered query against its SQL over the smallest tables."""

import importlib.util
import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    table = duck.sql(SQL[name]).to_arrow_table()
    columns = sorted(df.columns)
    assert columns == sorted(table.column_names)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in (x.asDict() for x in df.collect()))
    want = sorted(tuple(shown(r[c]) for c in columns) for r in table.to_pylist())
    assert got == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 6


def test_nothing_else_needs_the_llm_subpackage():
    root = os.path.dirname(importlib.util.find_spec("lodestone").origin)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                assert "lodestone.llm" not in open(os.path.join(folder, name)).read()
