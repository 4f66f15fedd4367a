"""Paths from both ends against a search from one, and what they read of a star."""

import random

from cartulary.operators import graph


def one_sided(edges, source, target):
    """Breadth first from source; the least edge, then the least node before, leads to a node."""
    both = [(a, b, e) for e, a, b in edges] + [(b, a, e) for e, a, b in edges]
    if source == target:
        return []
    seen, frontier, via = {source}, {source}, {}
    while frontier and target not in seen:
        new = {}
        for a, b, e in both:
            if a in frontier and b not in seen:
                new[b] = min(new.get(b, (e, a)), (e, a))
        via |= new
        seen |= set(new)
        frontier = set(new)
    if target not in seen:
        return None
    path = []
    while target != source:
        e, target = via[target]
        path.append(e)
    return path[::-1]


def frame(spark, edges):
    return spark.createDataFrame(edges, "id string, source string, target string")


def test_paths_are_those_of_a_search_from_the_source(spark):
    rng = random.Random(4)
    edges = [(f"e{rng.randrange(1000):04}", f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(48)]
    edges += [(f"c{i}", f"c{i}", f"c{i + 1}") for i in range(7)]
    df = frame(spark, edges).cache()
    nodes = sorted({x for _, a, b in edges for x in (a, b) if x.startswith("n")})
    for _ in range(6):
        a, b = rng.sample(nodes, 2)
        assert graph.shortest_path(df, a, b) == one_sided(edges, a, b), (a, b)
    assert graph.shortest_path(df, "c0", "c7") == [f"c{i}" for i in range(7)]
    assert graph.shortest_path(df, "c0", "c7", max_depth=6) is None and graph.shortest_path(df, "c0", "c3", max_depth=3) == ["c0", "c1", "c2"]
    assert graph.shortest_path(df, "c0", nodes[0]) is None and graph.shortest_path(df, "c0", "c0") == [] and graph.shortest_path(df, "gone", "c0") is None


def test_a_hub_is_not_opened(spark, monkeypatch):
    """Two leaves of a star with 5,000: no level has more than a node."""
    rows, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, *a, **k: rows.append((out := write(df, *a, **k)).count()) or out)
    df = frame(spark, [(f"e{i:05}", "hub" if i % 2 else f"leaf{i}", f"leaf{i}" if i % 2 else "hub") for i in range(5000)])
    assert graph.shortest_path(df, "leaf7", "leaf4000") == ["e00007", "e04000"]
    assert sum(rows) <= 4
