"""A corpus from raw documents to packed token ids.

STAGES: quality rules, MinHash near-duplicates, benchmark decontamination, mixing to target weights, token-id output. Each stage
reads what its predecessor kept, written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.shared import table, written
from cartulary.llm.stages import STAGES

#: Near duplicates, templates and tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
