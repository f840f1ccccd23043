"""The registered queries against their SQL, on the smallest driver tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAN_QUERIES = sorted(name for plan in entry.PLANS for name in plan.QUERIES)
PLAN_SQL = {name: sql for plan in entry.PLANS for name, sql in plan.ORACLE.items()}

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(PLAN_QUERIES) == set(PLAN_SQL)


@needs_data
@pytest.mark.parametrize("name", sorted(PLAN_SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(PLAN_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_push_down(spark):
    """A browse query reads its columns only and cuts with a top-k, not a full sort."""
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    plan = entry.queries()["top_by_kind"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "p_retailprice" in schema and "p_brand" not in schema
