"""The registered training-data queries that SQL can express, on the smallest tables."""

import os

import duckdb
import pytest

from codeweave.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = Q.QUERIES[name](spark, FOLDER)
    r = c.execute(Q.SQL[name])
    columns = [d[0] for d in r.description]
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    want = sorted((tuple(row[k] for k in order) for row in r.fetchall()), key=str)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(x) for x in df.select(*sorted(df.columns)).collect()), key=str) == want
