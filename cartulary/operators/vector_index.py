"""Inverted lists of vectors around trained centres, with exact re-ranking.

Centres are learned from a bounded sample; every vector goes to the list of its nearest centre, and lists are folders, so a search
reads those it needs. A vector x of a list with centre c and radius r (the greatest distance from c) has a score of at most
qc + |q| r for a query q. An approximate search reads the lists with the nearest centres, by default as large a share of them as
the sample needed for a recall of RECALL when the index was built (vectors without clusters need most lists); an exact one reads
lists from the greatest bound down, twice as many each time, until the k-th score is above the bound of all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators.search import vector_top_k
from cartulary.schema import EMBEDDINGS

#: Vectors that centres are learned from, those with the least hash; rounds of Lloyd's method; lists at most.
SAMPLE, ROUNDS, LISTS = 20_000, 8, 1024
#: Recall among the NEAREST best vectors of the sample that the share of lists is chosen for, and vectors that are asked.
RECALL, NEAREST, ASKED = 0.97, 20, 200
MEASURED = "measured"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and the distance."""
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    near = square.argmin(axis=1)
    return near, np.sqrt(np.maximum(square[np.arange(len(x)), near], 0))


def share_for_recall(x: np.ndarray, centres: np.ndarray) -> float:
    """The least share of the lists with which some of the vectors find RECALL of their best others, if each reads the lists with the nearest centres."""
    near, _ = _nearest(x, centres)
    place = []
    for q in x[:ASKED]:
        rank = np.empty(len(centres), np.int64)
        rank[np.argsort(-(centres @ q), kind="stable")] = np.arange(len(centres))
        place.append(rank[near[np.argsort(-(x @ q), kind="stable")[:NEAREST]]])
    return float(np.quantile(np.concatenate(place) + 1, RECALL, method="higher") / len(centres))


def learn_centres(embeddings: DataFrame, lists: int) -> tuple[np.ndarray, float]:
    """Centres of a sample of at most SAMPLE vectors, and the share of lists that a search needs."""
    rows = embeddings.select("entity_id", "embedding").orderBy(F.xxhash64("entity_id"), "entity_id").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(rows.column(0).combine_chunks())
    centres = x[:lists].copy()
    for _ in range(ROUNDS):
        near, _ = _nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres, share_for_recall(x, centres)


def build(embeddings: DataFrame, path: str, lists: int | None = None) -> None:
    """Writes embeddings (of one length, unit vectors by custom) as lists, and the centres, radii and sizes of those that have some. lists: by default the root of the number of vectors."""
    spark = embeddings.sparkSession
    embeddings = embeddings.filter("embedding is not null and size(embedding) > 0")
    n = embeddings.count()
    if not n:
        return
    centres, share = learn_centres(embeddings, int(np.clip(lists or n**0.5, 1, LISTS)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far = _nearest(_matrix(b.column("embedding")), centres)
            yield pa.record_batch([*b.columns, pa.array(near, pa.int32()), pa.array(far)], names=[*b.schema.names, "list", "distance"])

    rows = embeddings.select("entity_id", "entity_type", "embedding").mapInArrow(assigned, f"{EMBEDDINGS}, list int, distance double")
    rows.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    sizes = lists_of(spark, path).groupBy("list").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # LISTS at most
    rows = [(r["list"], [float(v) for v in centres[r["list"]]], r.radius, r.n, share) for r in sizes]
    spark.createDataFrame(rows, "list int, centre array<double>, radius double, n long, share double").coalesce(1).write.parquet(f"{path}/centres")


def lists_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{EMBEDDINGS}, distance double, list int").parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, query: list[float], k: int, entity_type: str | None = "function", probed: float | str | None = MEASURED) -> DataFrame:
    """entity_id and score of the k best vectors. probed: share of the lists that are read (the nearest), by default as measured; None: exact."""
    known = spark.read.parquet(f"{path}/centres").collect()  # LISTS at most
    q, centres = np.array(query, np.float64), np.array([r.centre for r in known])
    number = np.array([r["list"] for r in known])
    some = lambda order: vector_top_k(lists_of(spark, path).filter(F.col("list").isin(number[order].tolist())), query, k, entity_type)
    if probed is not None:
        probed = known[0].share if probed == MEASURED else probed
        order = np.argsort(-(centres @ q), kind="stable")
        enough = np.searchsorted(np.cumsum(np.array([r.n for r in known])[order]), 4 * k) + 1  # lists that hold some more than k
        return some(order[: max(int(enough), int(np.ceil(probed * len(known))))])
    bound = centres @ q + np.linalg.norm(q) * np.array([r.radius for r in known]) + 1e-6
    order = np.argsort(-bound, kind="stable")
    take = max(1, len(order) // 8)
    while take < len(order):
        scores = [r.score for r in some(order[:take]).collect()]  # k rows
        if len(scores) == k and scores[-1] > bound[order[take]]:
            break
        take *= 2
    return some(order[:take])
