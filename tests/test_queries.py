"""Every array query against its SQL on DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from gridloom.jobs import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(found):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in found), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    got = df.select(*names).collect()
    assert len(got) and rows(got) == rows(want)
