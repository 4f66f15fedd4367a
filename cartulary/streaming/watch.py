"""Watching a repository: its stream of changes, applied to the store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartulary.operators.embedding import Model
from cartulary.operators.index import index_changes
from cartulary.operators.parsing import Parser
from cartulary.operators.store import Store
from cartulary.scratch import scratch, written
from cartulary.sources.repository import register


def changes(spark: SparkSession, root: str, existing: bool = False) -> DataFrame:
    """The stream (op, path, content) of a folder; existing: files that are there at the start count as added."""
    register(spark)
    return spark.readStream.format("repository_changes").option("path", root).option("existing", str(existing).lower()).load()


def apply_changes(stream: DataFrame, store: Store, checkpoint: str, interval: str = "1 second", registry: dict[str, Parser] | None = None, model: Model | None = None, on_batch: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Applies a stream of changes; within a batch the last change of a path counts, so quick successive writes are one, and the source waits until a file is written.

    A batch that is run again after a failure gives the same store. on_batch gets the batch's number and its counts by op and of errors.
    """
    def batch(rows: DataFrame, number: int) -> None:
        with scratch():
            rows = written(rows.withColumn("seq", F.monotonically_increasing_id()), "changes")
            counts = {r.op: r["count"] for r in rows.groupBy("op").count().collect()}
            if counts:
                errors = index_changes(store, rows, registry, model)
                if on_batch:
                    on_batch(number, counts | {"errors": errors})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
