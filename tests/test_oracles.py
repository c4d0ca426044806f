"""Every query with SQL against DuckDB on the smallest tables, as the driver compares them."""

import math

import duckdb
import pytest

from sparrowgrid import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    kinds = {d[0]: str(d[1]) for d in rel.description}
    assert [(c, kinds[c]) for c, t in df.dtypes if t in KINDS and kinds[c] != KINDS[t]] == []
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_every_name_is_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
