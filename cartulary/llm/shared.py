"""What the operators have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.scratch import new_path, scratch, shared_dir, written

#: A side of a join is broadcast up to this many bytes of rows, counted before the join.
BROADCAST_BYTES = 8 << 20

#: Stands for a null doc_id as a join key; the output has the null again.
NO_ID = -(1 << 63)

#: The ASCII white space that separates words everywhere in this package.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def doc_key(doc_id: str = "doc_id") -> Column:
    """A doc_id as a join key."""
    return F.coalesce(doc_id, F.lit(NO_ID))


def row_key(*columns: str) -> Column:
    """What tells rows with one doc_id apart: 64 bits of hash of their text (or other columns)."""
    return F.xxhash64(*(columns or ("text",)))


def small_or_not(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table df, marked for broadcast if its counted rows take at most BROADCAST_BYTES; beyond that Spark's shuffle joins serve."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["BROADCAST_BYTES", "NO_ID", "WHITE", "WORD", "doc_key", "new_path", "row_key", "scratch", "shared_dir", "small_or_not", "table", "written"]
