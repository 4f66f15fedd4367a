import os

import pytest

import __spark_entry__
from cartulary.plans.catalogue import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else tuple(map(value, x)) if isinstance(x, list) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        found = duck.execute(SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(found.fetchall(), columns)
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_graph_nodes_take_no_sets_of_methods(spark):
    """Nodes need no lists of methods; rows that meet the parts' ids aren't sorted, and rows of nodes only after the shuffle."""
    df = QUERIES["graph_nodes"](spark, SMALL)
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "REPARTITION_BY_COL" in plan


def test_dot_export_gathers_methods_once(spark):
    """Only the edges need methods, and ids that edges are held against are not made distinct first."""
    plan = QUERIES["dot_export"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set(") == 1
    assert not any("Aggregate [id#" in line and "max_by" not in line for line in plan.splitlines())
