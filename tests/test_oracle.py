"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftgraph.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df, said = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(said.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(said.columns, said.types)}
    order = ", ".join(f'"{c}"' for c in cols)
    assert rows(df.select(*(f"`{c}`" for c in cols)).collect()) == rows(duck.sql(f"select {order} from ({oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
