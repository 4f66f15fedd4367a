"""Knowledge graph: nodes and edges of the entity tables, neighbourhoods, paths, clusters, statistics and exports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.constants import NODE_COLOURS, NODE_RADII, OTHER_COLOUR, OTHER_RADIUS
from cartulary.functions.text import round2
from cartulary.operators.ordinals import numbered
from cartulary.scratch import scratch, written

#: Order of node kinds; where ids coincide the later kind counts.
KINDS = ("file", "function", "class", "type")


def node_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """(id) of all nodes, as often as they are listed."""
    return reduce(DataFrame.union, (tables[t].select("id") for t in ("files", "functions", "classes", "types")))


def nodes(tables: dict[str, DataFrame], type_wins: bool = True, properties: bool = True) -> DataFrame:
    """(id, type, label, properties). A type with a class's id takes its place (type_wins) or stands beside it. properties: whether those are needed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    props = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), v)))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    parts = [
        tables["files"].select("id", F.lit("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("label"), props(path=text("path"), language=text("language"), tokenCount=text("token_count"), isTest=text("is_test")).alias("properties")),
        tables["functions"].select("id", F.lit("function"), "full_name", props(name=text("name"), signature=text("signature"), isExported=text("is_exported"), isAsync=text("is_async"), complexity=text("complexity"))),
        tables["classes"].select("id", F.lit("class"), "name", props(methods=count("methods"), properties=count("properties"), isExported=text("is_exported"))),
        tables["types"].select("id", F.lit("type"), "name", props(kind=text("kind"), memberCount=count("properties"))),
    ]
    rows = reduce(DataFrame.union, parts)
    rows = rows if properties else rows.drop("properties")
    if not type_wins:
        return rows
    rank = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("type"))
    # Ids hardly repeat, so a sort of all that a task reads, before the shuffle, would only take memory.
    last = rows.repartition("id").groupBy("id").agg(F.max_by(F.struct(*rows.columns[1:]), F.struct(rank, "label")).alias("n"))
    return last.select("id", "n.*")


def edges(tables: dict[str, DataFrame], node_ids: DataFrame, parity: bool = False) -> DataFrame:
    """(id, source, target, type, label). Edges to ids that aren't nodes are left out.

    Relationships are taken once each. parity=True takes one for each of its ends that is a file, as the original count does.
    """
    ids = node_ids.select("id")
    target = ids.select(F.col("id").alias("target"))

    def edge(df: DataFrame, source: Column, to: Column, kind: str, label: str) -> DataFrame:
        return df.select(F.concat(F.lit("edge:"), source, F.lit(f":{kind}:"), to).alias("id"), source.alias("source"), to.alias("target"), F.lit(kind).alias("type"), F.lit(label).alias("label"))

    known = lambda df: df.join(target, "target", "left_semi").select("id", "source", "target", "type", "label")
    c, file = F.col, F.col("file_id")
    methods = tables["classes"].select("id", F.explode("methods").alias("m"))
    parts = [
        edge(tables["functions"], file, c("id"), "has_function", "contains"), edge(tables["classes"], file, c("id"), "has_class", "contains"),
        known(edge(methods, c("id"), c("m"), "has_method", "method")), known(edge(tables["classes"].filter("extends_id is not null"), c("id"), c("extends_id"), "extends", "extends")),
        edge(tables["types"], file, c("id"), "has_type", "contains"),
    ]
    if (rel := tables.get("relationships")) is not None:
        r = rel.select("id", c("source_id").alias("source"), c("target_id").alias("target"), c("relation_type").alias("type"), c("relation_type").alias("label"))
        files = tables["files"].select(c("id").alias("f"))
        r = known(r).join(ids.select(c("id").alias("source")), "source", "left_semi").select("id", "source", "target", "type", "label")
        ends = F.array_distinct(F.array("source", "target")) if parity else F.array("source")
        at_file = r.withColumn("f", F.explode(ends)).join(files, "f", "left_semi").drop("f") if parity else r
        parts.append(at_file)
    return reduce(DataFrame.unionByName, parts)


def stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, type, n): counts of nodes and edges by type, and both totals (type null)."""
    by = lambda df, k: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "type", "n")
    both = by(node_rows, "node").union(by(edge_rows, "edge"))
    return both.union(both.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit(None).cast("string").alias("type"), "n"))


def average_degree(counts: DataFrame, decimals: int = 2) -> DataFrame:
    """(average_degree) from stats(): twice the edges by the nodes; 0 without nodes."""
    n = counts.filter("type is null").agg(F.max(F.when(F.col("kind") == "node", F.col("n"))).alias("v"), F.max(F.when(F.col("kind") == "edge", F.col("n"))).alias("e"))
    degree = F.when(F.coalesce("v", F.lit(0)) > 0, F.coalesce("e", F.lit(0)) * 2 / F.col("v")).otherwise(F.lit(0.0))
    scale = 10**decimals
    return n.select((F.floor(degree * scale + F.lit(0.5)) / float(scale)).alias("average_degree"))


def undirected(edge_rows: DataFrame) -> DataFrame:
    """(a, b, id): each edge both ways."""
    return edge_rows.select(F.col("source").alias("a"), F.col("target").alias("b"), "id").union(edge_rows.select("target", "source", "id"))


def neighbours(edge_rows: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """(id, distance, edge_id) of the nodes within depth edges of start, itself excluded; edge_id: the least edge that leads there from the round before."""
    both = undirected(edge_rows)
    spark = edge_rows.sparkSession
    with scratch():
        seen = spark.createDataFrame([(start, 0, None)], "id string, distance int, edge_id string")
        frontier = seen
        for d in range(1, depth + 1):
            step = frontier.select(F.col("id").alias("a")).join(both, "a").groupBy(F.col("b").alias("id")).agg(F.min("id").alias("edge_id"))
            frontier = written(step.join(seen, "id", "left_anti").select("id", F.lit(d).alias("distance"), "edge_id"), "ring")
            if frontier.isEmpty():
                break
            seen = seen.union(frontier)
        return written(seen.filter("distance > 0"), "neighbours", keep=True)


def shortest_path(edge_rows: DataFrame, source: str, target: str, max_depth: int | None = None) -> list[str] | None:
    """Edge ids of a shortest undirected path (the least ones), [] if source is target, None if there is none (or none of max_depth edges, if given)."""
    if source == target:
        return []
    with scratch():
        return _search(edge_rows, source, target, max_depth)


def _search(edge_rows: DataFrame, source: str, target: str, max_depth: int | None) -> list[str] | None:
    """From both ends, a written table for each level; the end with fewer nodes at its edge goes on, so a hub between them isn't opened.

    Where the two meet, the way to the target is gone forward through its levels, which are nearer to it by one each; then back from
    the target. Of several ways to a node that with the least edge (then the least node before) counts, as if all were searched
    from source: a node before another one on a shortest path is in the level next to it on either side.
    """
    both, spark = undirected(edge_rows), edge_rows.sparkSession

    def step(frontier: DataFrame) -> DataFrame:
        near = frontier.select(F.col("id").alias("a")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("id", "a")).alias("via"))
        return near.select(F.col("node").alias("id"), F.col("via.a").alias("before"), F.col("via.id").alias("edge_id"))

    sides = [[spark.createDataFrame([(end, None, None)], "id string, before string, edge_id string")] for end in (source, target)]
    size = [1, 1]
    while max_depth is None or len(sides[0]) + len(sides[1]) - 2 < max_depth:
        i = min((0, 1), key=lambda x: (size[x], len(sides[x])))  # of equals the one that has gone less far
        own, other = sides[i], sides[1 - i]
        # Edges go both ways, so a neighbour that has been seen is on this level or the one before.
        seen = own[-1] if len(own) == 1 else own[-1].union(own[-2])
        own.append(written(step(own[-1]).join(seen.select("id"), "id", "left_anti"), "level"))
        size[i] = own[-1].count()
        if not size[i]:
            return None
        met = own[-1].select("id").join(other[-1].select("id"), "id", "left_semi")
        if not met.isEmpty():
            break
    else:
        return None
    forward, backward = sides
    here = met
    for level in reversed(backward[:-1]):
        here = written(step(here).join(level.select("id"), "id", "left_semi"), "level")
        forward.append(here)
    path, at = [], target
    for level in reversed(forward[1:]):  # one row a level
        row = level.filter(F.col("id") == at).first()
        path.append(row.edge_id)
        at = row.before
    return path[::-1]


def components(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(id, component): the least id that a node reaches.

    Each round a node takes the least label of itself, its neighbours and its label's label (pointer jumping), so chains need a
    number of rounds that grows with their length's logarithm, not with the length.
    """
    with scratch():
        both = written(undirected(edge_rows).select("a", "b").filter("a <> b").distinct(), "both-ways")
        labels, changed = written(node_rows.select("id", F.col("id").alias("component")).distinct(), "labels"), True
        while changed:
            with scratch():
                after = written(_round(both, labels), "labels", keep=True)
            changed = not after.filter("new <> component").isEmpty()
            labels = after.select("id", F.col("new").alias("component"))
        return written(labels, "components", keep=True)


def _round(both: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with `new`, the label after one round."""
    of = lambda k, v: labels.select(F.col("id").alias(k), F.col("component").alias(v))
    near = both.join(of("b", "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near"))
    step = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("least"))
    # A label's own label may be less already; and what a node has learned holds for its label too.
    hooks = step.filter("least < component").groupBy(F.col("component").alias("id")).agg(F.min("least").alias("hook"))
    hooked = step.join(hooks, "id", "left").select("id", "component", F.least("least", F.coalesce("hook", "least")).alias("least"))
    jump = hooked.select(F.col("id").alias("least"), F.col("least").alias("jump"))
    return hooked.join(jump, "least", "left").select("id", "component", F.least("least", F.coalesce("jump", "least")).alias("new"))


def clusters(node_rows: DataFrame, edge_rows: DataFrame, min_size: int = 3) -> DataFrame:
    """(cluster, name, size, edges, density) of components with min_size nodes or more, largest first; numbered by least id.

    density: edges (as often as they are listed) by n(n-1)/2. The name is the files' longest common directory, found from the
    least and the greatest directory.
    """
    label = components(node_rows, edge_rows)
    is_file = F.when(F.col("type") == "file", F.array_join(F.slice(F.split(F.col("properties")["path"], "/"), 1, F.size(F.split(F.col("properties")["path"], "/")) - 1), "\u0001"))
    sizes = node_rows.join(label, "id").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min(is_file).alias("lo"), F.max(is_file).alias("hi")).filter(F.col("size") >= min_size)
    inside = edge_rows.join(label.select(F.col("id").alias("source"), "component"), "source").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    pair = F.arrays_zip(F.split("lo", "\u0001").alias("x"), F.split("hi", "\u0001").alias("y"))
    prefix = F.aggregate(pair, F.struct(F.lit("").alias("p"), F.lit(True).alias("on")), lambda s, v: F.struct(
        F.when(s["on"] & v["x"].eqNullSafe(v["y"]), F.concat(s["p"], F.when(s["p"] == "", "").otherwise("/"), v["x"])).otherwise(s["p"]).alias("p"), (s["on"] & v["x"].eqNullSafe(v["y"])).alias("on")))["p"]
    name = F.when(F.coalesce(prefix, F.lit("")) != "", prefix).otherwise(F.concat(F.lit("Cluster-"), "size", F.lit("-nodes")))
    density = F.coalesce("edges", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2)
    out = sizes.join(inside, "component", "left").select("component", name.alias("name"), "size", F.coalesce("edges", F.lit(0)).alias("edges"), round2(density).alias("density"))
    return out.orderBy(F.col("size").desc(), "component")


def numbered_clusters(found: DataFrame) -> DataFrame:
    """clusters() with number (from 0, the largest first, then by least id) and key, cluster-<number>."""
    out = numbered(found, [], [F.col("size").desc(), F.col("component")], "_n").withColumn("number", F.col("_n") - 1).drop("_n")
    return out.withColumn("key", F.concat(F.lit("cluster-"), "number"))


def of_types(node_rows: DataFrame, edge_rows: DataFrame, types: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types (the first `limit` by id, for display) and the edges between them."""
    kept = node_rows.filter(F.col("type").isin(types))
    kept = kept if limit is None else kept.orderBy("id").limit(limit)
    inside = edge_rows
    for end in ("source", "target"):
        inside = inside.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    return kept, inside.select(edge_rows.columns)


def radial_layout(node_rows: DataFrame, radius: float = 1.0) -> DataFrame:
    """(id, type, x, y): a ring for each node type that there is, its nodes in the order of ids at equal angles."""
    kind = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("type"))
    known = node_rows.filter(F.col("type").isin(*KINDS))
    rings = known.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.first(kind).alias("kind"))  # four rows at most
    rings = rings.withColumn("r", radius * (F.lit(0.3) + 0.25 * (F.row_number().over(Window.orderBy("kind")) - 1)))
    placed = numbered(known.select("id", "type"), ["type"], ["id"], "i").join(F.broadcast(rings), "type")
    angle = F.lit(6.283185307179586) * (F.col("i") - 1) / F.col("n")
    return placed.select("id", "type", (F.col("r") * F.cos(angle)).alias("x"), (F.col("r") * F.sin(angle)).alias("y"))


def node_radius(kind: Column) -> Column:
    out = F.lit(OTHER_RADIUS)
    for k, v in NODE_RADII.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def colour(kind: Column) -> Column:
    out = F.lit(OTHER_COLOUR)
    for k, v in NODE_COLOURS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def dot_lines(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(part, ord, line): the lines of a DOT file but its head and tail; sort by part and ord. Ids are not escaped."""
    n = node_rows.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit('  "'), "id", F.lit('" [label="'), "label", F.lit('", fillcolor="'), colour(F.col("type")), F.lit('"];')).alias("line"))
    e = edge_rows.select(F.lit(2).alias("part"), F.col("id").alias("ord"), F.concat(F.lit('  "'), "source", F.lit('" -> "'), "target", F.lit('" [label="'), "type", F.lit('"];')).alias("line"))
    return n.union(e)


# Fixed value: the head of a DOT file.
DOT_HEAD = "digraph KnowledgeGraph {\n  rankdir=LR;\n  node [shape=box, style=filled, fillcolor=lightblue];\n\n"


def to_dot(node_rows: DataFrame, edge_rows: DataFrame) -> str:
    """The whole DOT text, for graphs that fit the driver; large ones are written with dot_lines(...).write.text."""
    lines = dot_lines(node_rows, edge_rows).orderBy("part", "ord", "line").collect()
    body = lambda p: "".join(x.line + "\n" for x in lines if x.part == p)
    return f"{DOT_HEAD}{body(1)}\n{body(2)}}}\n"


def _entries(rows: DataFrame) -> DataFrame:
    """rows with maps as lists of entries: collected maps lose their order."""
    return rows.select(*(F.map_entries(c).alias(c) if t.startswith("map") else c for c, t in rows.dtypes))


def _in_order(row: dict) -> dict:
    return {k: {e.key: e.value for e in v} if isinstance(v, list) else v for k, v in row.items()}


def to_json(node_rows: DataFrame, edge_rows: DataFrame) -> str:
    """Nodes, edges, clusters and a summary as JSON, for graphs that fit the driver."""
    found = clusters(node_rows, edge_rows).collect()
    n, e = ([_in_order(r.asDict()) for r in _entries(rows.orderBy("id")).collect()] for rows in (node_rows, edge_rows))
    groups = [{"id": f"cluster-{i}", "name": c.name, "size": c.size, "edges": c.edges, "density": c.density} for i, c in enumerate(found)]
    return json.dumps({"nodes": n, "edges": e, "clusters": groups, "summary": {"totalNodes": len(n), "totalEdges": len(e), "totalClusters": len(groups)}}, indent=2, ensure_ascii=False)
