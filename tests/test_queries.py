"""Every registered query against its SQL on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from millrace.plans.catalogue import load_all

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"]
QUERIES, CHECKS = load_all()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6))
    return repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in FORBIDDEN), plan
    lines = plan.splitlines()
    gathers = [below for line, below in zip(lines, lines[1:]) if "Exchange SinglePartition" in line]
    assert all("Aggregate" in below for below in gathers), "only partial aggregates may meet in one task"
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = database.execute(CHECKS[name])
    labels = [c[0] for c in result.description]
    order = [labels.index(c) for c in sorted(labels)]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert columns == sorted(labels)
    assert ours == theirs
    assert ours


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
