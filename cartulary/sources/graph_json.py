"""Graphs exported as JSON, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = """nodes array<struct<id:string,type:string,label:string,properties:map<string,string>>>, edges array<struct<id:string,source:string,target:string,type:string,label:string>>"""


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON export."""
    rows = spark.read.schema(_SCHEMA).json(path, multiLine=True)
    return rows.select(F.explode("nodes").alias("n")).select("n.*"), rows.select(F.explode("edges").alias("e")).select("e.*")
