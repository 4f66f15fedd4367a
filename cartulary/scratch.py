"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts the lineage of what is built on it and survives the loss of executors. Tables live until the session's JVM
ends, or, if they are made inside `scratch()`, until that block ends; those that a lazy result still reads are made with keep=True
and pass to the block around it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local = threading.local()
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own if that is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cartulary-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _hadoop(spark: SparkSession, path: str):
    """A path's file system and the path, as Spark's JVM knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, place = _hadoop(spark, path)
    system.deleteOnExit(place)
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but those made with keep=True."""
    outer = getattr(_local, "scope", None)
    _local.scope = scope = {"done": [], "kept": []}
    try:
        yield
    finally:
        _local.scope = outer
        for spark, path in scope["done"]:
            system, place = _hadoop(spark, path)
            system.delete(place, True)
        if outer is not None:
            outer["done"] += scope["kept"]


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder. keep: what the surrounding scratch() returns reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if (scope := getattr(_local, "scope", None)) is not None:
        scope["kept" if keep else "done"].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
