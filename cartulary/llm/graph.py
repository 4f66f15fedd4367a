"""Connected components of an edge list, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): every node of a link with the smallest node that it reaches.

    Large-star and small-star steps in turn; both keep the components and at least halve the distance to the smallest node, so
    the rounds grow with the logarithm of the longest chain. Each star is an aggregate (partial sums first) and a join, which
    Spark splits where a node has very many links. A round's edges are written, which cuts the lineage.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).union(edges.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
        least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
        large = both.filter("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("least").alias("lo"))
        large = large.filter("lo <> hi").distinct()
        root = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        small = large.join(root, large["hi"] == root["node"]).select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e")).select("e.lo", "e.hi")
        edges = written(small.filter("lo <> hi").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = state
