"""Every query with SQL against DuckDB on the smallest tables, and plans that must not hold certain nodes."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
import quorumframe.queries as own

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = own.QUERIES[name](spark, FOLDER)
    found = duck.execute(own.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    expected = sorted(tuple(_plain(r[k]) for k in at) for r in found.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(own.QUERIES.keys() - own.ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert own.QUERIES[name](spark, FOLDER).count() > 0


def _loops(plan) -> list:
    """Nested loops of a plan whose broadcast side can have more than one row."""
    name, found = plan.nodeName(), []
    if name == "CartesianProduct":
        found.append(name)
    if name == "BroadcastNestedLoopJoin":
        sides = [plan.left(), plan.right()]
        if not any(_single_row(side) for side in sides):
            found.append(plan.toString()[:300])
    children = plan.children()
    for k in range(children.size()):
        found += _loops(children.apply(k))
    return found


def _single_row(plan) -> bool:
    """Whether a side is one global aggregate, below its projections, filters and exchanges."""
    while True:
        name = plan.nodeName()
        if name in ("HashAggregate", "ObjectHashAggregate", "SortAggregate"):
            return plan.groupingExpressions().isEmpty()
        children = plan.children()
        if children.size() != 1:
            return False
        plan = children.apply(0)


def test_nested_loops_meet_one_row_at_most(spark):
    plans = {name: build(spark, FOLDER)._jdf.queryExecution().sparkPlan() for name, build in own.QUERIES.items()}
    assert not {name: loops for name, plan in plans.items() if (loops := _loops(plan))}


def test_entry(spark):
    assert entry.entry(spark).columns == ["group_id", "n"]
    assert own.QUERIES.keys() <= entry.queries().keys() and own.ORACLE_SQL.keys() <= entry.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
