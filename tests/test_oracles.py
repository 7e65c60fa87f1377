"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from tapeworks import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "tinyint": "TINYINT", "smallint": "SMALLINT"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _cell(x):
    return None if isinstance(x, float) and math.isnan(x) else 0.0 if isinstance(x, float) and x == 0 else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, sf, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql()[name]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(_cell(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
