"""Graphs of any size as one file: ordered parts written by Spark, joined by the file system.

The text is that of graph.to_json and graph.to_dot with a line break at the end. Rows become lines in tasks, are sorted over ranges and written;
then the parts' bytes are copied in order from file to file, a buffer at a time. No row passes the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import graph
from cartulary.operators.ordinals import numbered
from cartulary.scratch import new_path, scratch, written

_LINES = "section int, n long, line string"


def join_parts(spark: SparkSession, parts: str, path: str) -> None:
    """The part files of a folder, in order, as one file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, to = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    source = place.getFileSystem(conf)
    out = to.getFileSystem(conf).create(to, True)
    try:
        for part in sorted((x.getPath() for x in source.listStatus(place) if x.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            stream = source.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()


def write_lines(lines: DataFrame, path: str) -> None:
    """lines (section, n, line) as one file, by section and n."""
    spark = lines.sparkSession
    parts = new_path(spark, "lines")
    lines.orderBy("section", "n").select("line").write.text(parts)
    join_parts(spark, parts, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parts)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _fixed(spark: SparkSession, lines: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame([(s, 0, x) for s, x in lines], _LINES)


def write_dot(node_rows: DataFrame, edge_rows: DataFrame, path: str) -> None:
    """graph.to_dot's text."""
    with scratch():
        body = graph.dot_lines(node_rows, edge_rows)
        ordered = numbered(body, [], ["part", "ord", "line"]).select((2 * F.col("part") - 1).cast("int").alias("section"), "n", "line")
        ends = [(0, graph.DOT_HEAD.removesuffix("\n")), (2, ""), (4, "}")]
        write_lines(ordered.union(_fixed(node_rows.sparkSession, ends)), path)


def _objects(section: int, total: int):
    """Rows with n -> their JSON, indented as in a list of an object."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = []
            for row in b.to_pylist():
                n = row.pop("n")
                plain = {k: dict(v) if isinstance(v, list) else v for k, v in row.items()}  # maps come as lists of pairs
                text = json.dumps(plain, indent=2, ensure_ascii=False)
                lines.append("\n".join(f"    {x}" for x in text.split("\n")) + ("," if n < total else ""))
            yield pa.record_batch([pa.array([section] * len(lines), pa.int32()), b.column("n"), pa.array(lines, pa.string())], names=["section", "n", "line"])

    return run


def write_json(node_rows: DataFrame, edge_rows: DataFrame, path: str) -> None:
    """graph.to_json's text."""
    spark = node_rows.sparkSession
    with scratch():
        found = graph.numbered_clusters(graph.clusters(node_rows, edge_rows)).select(F.col("key").alias("id"), "name", "size", "edges", "density", (F.col("number") + 1).alias("n"))
        lists = {"nodes": numbered(node_rows, [], ["id"]), "edges": numbered(edge_rows, [], ["id"]), "clusters": written(found, "clusters")}
        parts, fixed, totals = [], [(0, "{")], []
        for i, (name, rows) in enumerate(lists.items()):
            totals.append(total := rows.count())
            fixed += [(3 * i + 1, f'  "{name}": ['), (3 * i + 3, "  ],")] if total else [(3 * i + 1, f'  "{name}": [],')]
            parts.append(rows.mapInArrow(_objects(3 * i + 2, total), _LINES))
        summary = json.dumps(dict(zip(("totalNodes", "totalEdges", "totalClusters"), totals, strict=True)), indent=2).replace("\n", "\n  ")
        fixed.append((99, f'  "summary": {summary}\n}}'))
        write_lines(reduce(DataFrame.union, parts).union(_fixed(spark, fixed)), path)
