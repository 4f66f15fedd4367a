"""Cohesion against all pairs, by joins and by blocks."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cartulary.operators import architecture


def brute(files, names):
    """files: (module, file); names: sets by file."""
    out = {}
    for m in {m for m, _ in files}:
        own = [names.get(f, set()) for x, f in files if x == m]
        total = sum(len(a & b) / len(a | b) if a | b else 0.0 for a, b in combinations(own, 2))
        if len(own) > 1:
            out[m] = total / (len(own) * (len(own) - 1) / 2)
    return out


@pytest.mark.parametrize(("hot", "block"), [(10**6, 512), (3, 4), (0, 1), (5, 1000)])
def test_cohesion_is_that_of_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(architecture, "HOT_SETS", hot)
    monkeypatch.setattr(architecture, "SET_BLOCK", block)
    rng = random.Random(hot)
    files = [(f"a/m{i % 3}", f"a/m{i % 3}/f{i}.ts") for i in range(60)]
    names = {f: {rng.choice("abcdefghij") if rng.random() < 0.6 else f"own{rng.randrange(9)}" for _ in range(rng.randint(1, 5))} | ({"hot"} if rng.random() < 0.5 else set()) for _, f in files if rng.random() < 0.9}
    names[files[4][1]] = names[files[1][1]] = {"hot", "a"}
    members = spark.createDataFrame([(m, f, f) for m, f in files], "root_path string, file_id string, path string")
    exports = spark.createDataFrame([(f, n) for f, own in names.items() for n in own], "file_id string, full_name string")
    got = {r.root_path: r.cohesion for r in architecture.cohesion(members, exports).collect()}
    assert got == pytest.approx(brute(files, names))


def test_a_name_that_ten_thousand_sets_have(spark):
    """50 million pairs share one name: they are summed in blocks, and no plan node makes them."""
    n = 10_000
    rows = spark.range(n).select(F.lit("a/big").alias("root_path"), F.concat(F.lit("a/big/"), "id").alias("file_id"), F.col("id").cast("string").alias("path"))
    exports = rows.select("file_id", F.explode(F.array(F.lit("shared"), F.concat(F.lit("own"), "path"))).alias("full_name"))
    df = architecture.cohesion(rows, exports)
    assert [r.cohesion for r in df.collect()] == [pytest.approx(1 / 3)]
    made = []

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        if plan.metrics().contains("numOutputRows"):
            made.append(plan.metrics().apply("numOutputRows").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert max(made) < 30 * n
