"""Numbers and running sums over groups of any size, against plain Python."""

import os
import random

from pyspark.sql import functions as F

from cartulary.operators import graph, ordinals, search
from cartulary.scratch import scratch


def plain(rows, by, order):
    """(number, running sum) by row, in order."""
    out, n, total = {}, {}, {}
    for r in sorted(rows, key=order):
        g = by(r)
        n[g] = n.get(g, 0) + 1
        if r[2] is not None:
            total[g] = total.get(g, 0) + r[2]
        out[r] = (n[g], total.get(g))
    return out


def test_numbered_with_a_hot_group_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "RANGE_ROWS", 200)
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), i, rng.choice([None, 0, 3, -2, 10])) for i in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = ordinals.numbered(df, ["g"], ["k"], "n", {"total": "v"})
    assert got.columns == ["g", "k", "v", "n", "total"]
    assert {(r.g, r.k, r.v): (r.n, r.total) for r in got.collect()} == plain(rows, lambda r: r[0], lambda r: r[1])
    # One group of all rows, in descending order.
    got = ordinals.numbered(df, [], [F.col("k").desc()], "n", {"total": "v"})
    assert {(r.g, r.k, r.v): (r.n, r.total) for r in got.collect()} == plain(rows, lambda r: 0, lambda r: -r[1])
    assert ordinals.numbered(df.limit(0), ["g"], ["k"]).count() == 0
    # No task has more than its range, though one group has most rows.
    with scratch():
        sizes = [r["count"] for r in ordinals.ranged(df, ["g", "k"]).groupBy("_part").count().collect()]
    assert max(sizes) < 3 * 200 and len(sizes) >= 12


def test_budget_of_one_group(spark):
    rows = spark.range(5000).select(F.lit("en").alias("language"), F.col("id").alias("pos"), (F.col("id") % 7).alias("tokens"))
    out = {r.pos: (r.running, r.kept) for r in search.token_budget(rows, 1000, ["language"]).collect()}
    total = 0
    for i in range(5000):
        total += i % 7
        assert out[i] == (total, total <= 1000)


def test_middle(spark):
    paths = [f"src/{i:04}" for i in range(0, 2001, 3)]
    df = spark.createDataFrame([(p,) for p in reversed(paths)] + [("src/0003",)] * 40, "path string")
    everything = sorted([*paths, *["src/0003"] * 40])
    assert ordinals.middle(df, "path") == everything[len(everything) // 2]
    assert ordinals.middle(df.limit(0), "path") is None and ordinals.middle(df.limit(1), "path") is not None


def test_cluster_numbers(spark):
    found = spark.createDataFrame([("b", "x", 5, 4, 0.4), ("a", "y", 5, 4, 0.4), ("c", "z", 9, 8, 0.2)], "component string, name string, size long, edges long, density double")
    assert [(r.key, r.component) for r in graph.numbered_clusters(found).orderBy("number").collect()] == [("cluster-0", "c"), ("cluster-1", "a"), ("cluster-2", "b")]


def test_tables_of_graph_rounds_do_not_stay(spark, tmp_path, monkeypatch):
    """What components() and neighbours() leave in the shared folder is one table each, and nothing inside scratch()."""
    nodes = spark.createDataFrame([(str(i),) for i in range(6)], "id string")
    edges = spark.createDataFrame([("1", "2", "e1"), ("2", "3", "e2")], "source string, target string, id string")
    monkeypatch.setattr("cartulary.scratch.shared_dir", lambda spark: str(tmp_path))
    with scratch():
        assert graph.components(nodes, edges).count() == 6 and graph.neighbours(edges, "1", 2).count() == 2
    assert not os.listdir(tmp_path)
    graph.components(nodes, edges).count(), graph.neighbours(edges, "1", 2).count()
    assert sorted(x.split("-")[0] for x in os.listdir(tmp_path)) == ["components", "neighbours"]
