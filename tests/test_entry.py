"""The driver's contract, and that frames say what joins say."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(row[names.index(c)] for c in sorted(names))) for row in r.fetchall())
    assert sorted(str(tuple(row[c] for c in sorted(names))) for row in df.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_plans_have_no_python_and_no_band_join(spark):
    for name in ("tool_error", "retry_after_error", "incidents_union", "stratified_sample"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin")), name
