"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tesseral.plans import catalogue  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF_DIR):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return c


def plain(rows):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = con.execute(catalogue.SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([tuple(r[i] for i in places) for r in cursor.fetchall()])


def test_plans_push_filters_and_prune_columns(spark):
    db = catalogue.client(spark, SF_DIR)
    plan = db.orders.find_many({"o_orderdate": {"gte": "1995-01-01"}, "o_custkey": {"in": [1, 2]}}, select=["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan and "In(o_custkey, [1,2])" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    plan = db.customer.find_many({"orders": {"some": {"o_totalprice": {"gt": 1}}}})._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    plan = db.orders.find_many(order_by={"o_totalprice": "desc"}, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = db.customer.find_many(include={"orders": {"limit": 2, "orderBy": {"o_totalprice": "desc"}}})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
