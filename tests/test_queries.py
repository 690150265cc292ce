"""Each query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from codeweave import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("events",):
        c.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, db, name):
    df = Q.QUERIES[name](spark, FOLDER)
    r = db.execute(Q.SQL[name])
    columns = [d[0] for d in r.description]
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    want = sorted((tuple(row[k] for k in order) for row in r.fetchall()), key=str)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(x) for x in df.select(*sorted(df.columns)).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_queries_without_sql_have_rows(spark, name):
    assert Q.QUERIES[name](spark, FOLDER).count() > 0


def test_line_windows_take_one_window_and_two_shuffles(spark):
    plan = Q.acc(spark, FOLDER, forward=2).counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Exchange") == 2
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp" in plan.replace("timestamp_ntz", "timestamp") and "props" not in plan
