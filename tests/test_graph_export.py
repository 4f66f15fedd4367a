"""Exports as joined parts against the small ones, byte for byte."""

import json

import pytest
from pyspark.sql import DataFrame

from cartulary.operators import graph, graph_export, ordinals


def exported(write, nodes, edges, path, monkeypatch):
    with monkeypatch.context() as m:  # nothing is collected
        m.setattr(type(nodes), "collect", lambda self: pytest.fail("rows pass the driver"))
        write(nodes, edges, str(path))
    return path.read_text()


def test_exports_of_a_graph(spark, tables, tmp_path, monkeypatch):
    assert isinstance(tables["files"], DataFrame)
    nodes = graph.nodes(tables)
    edges = graph.edges(tables, nodes)
    text = exported(graph_export.write_json, nodes, edges, tmp_path / "g.json", monkeypatch)
    assert text == graph.to_json(nodes, edges) + "\n" and len(json.loads(text)["nodes"]) == nodes.count()
    assert exported(graph_export.write_dot, nodes, edges, tmp_path / "g.dot", monkeypatch) == graph.to_dot(nodes, edges)
    none = nodes.limit(0), edges.limit(0)
    assert exported(graph_export.write_json, *none, tmp_path / "n.json", monkeypatch) == graph.to_json(*none) + "\n"
    assert exported(graph_export.write_dot, *none, tmp_path / "n.dot", monkeypatch) == graph.to_dot(*none)


def test_exports_in_many_parts(spark, tmp_path, monkeypatch):
    """More rows than one range, names that JSON escapes, several clusters."""
    monkeypatch.setattr(ordinals, "RANGE_ROWS", 50)
    nodes = spark.range(600).selectExpr("concat('n', id, '\"\\\\\\n\\u00e9') AS id", "if(id % 3 = 0, 'file', 'class') AS type", "concat('l', id, char(7)) AS label", "map('path', concat('a/', id % 4, '/f'), 'x', '') AS properties")
    ids = [r.id for r in nodes.collect()]
    edges = spark.createDataFrame([(f"e{i:03}", ids[i], ids[i + 1 if i % 7 else i - i % 7], "imports", "imports") for i in range(599)], "id string, source string, target string, type string, label string")
    assert exported(graph_export.write_json, nodes, edges, tmp_path / "g.json", monkeypatch) == graph.to_json(nodes, edges) + "\n"
    assert exported(graph_export.write_dot, nodes, edges, tmp_path / "g.dot", monkeypatch) == graph.to_dot(nodes, edges)
