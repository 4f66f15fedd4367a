"""Inverted lists against the scan: exact mode, recall, and how much is read."""

import os
import random

import pytest

from cartulary.operators import search, store, vector_index
from tests.conftest import DATA
from tests.test_operators import frame
from tests.test_store_index import files_read


def unit(rng, dims, near=None):
    v = [rng.gauss(0, 1) + (4 * x if near else 0) for x in near or [0] * dims]
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(1)
    centres = [unit(rng, 16) for _ in range(12)]
    rows = [(f"f{i}", "function" if i % 9 else "class", unit(rng, 16, rng.choice(centres))) for i in range(1500)] + [(f"same{i}", "function", unit(random.Random(5), 16)) for i in range(30)]
    return frame(spark, "embeddings", [dict(zip(("entity_id", "entity_type", "embedding"), r)) for r in rows]).cache(), [unit(rng, 16, c) for c in centres[:4]] + [unit(random.Random(5), 16)]


def test_exact_mode_is_the_scan(spark, vectors, tmp_path):
    rows, queries = vectors
    vector_index.build(rows, str(tmp_path / "v"))
    for q in queries:
        for kind in ("function", None):
            scan = search.vector_top_k(rows, q, 20, kind).collect()
            assert vector_index.search(spark, str(tmp_path / "v"), q, 20, kind, probed=None).collect() == scan
    assert len(vector_index.search(spark, str(tmp_path / "v"), queries[0], 2000, None, probed=None).collect()) == 1530


def recall(found, scan):
    return len({r.entity_id for r in found} & {r.entity_id for r in scan}) / len(scan)


def test_recall_and_what_is_read(spark, vectors, tmp_path):
    """Vectors in clusters: most neighbours from a share of the lists. Those of the test tables have no clusters, and need more."""
    rows, queries = vectors
    vector_index.build(rows, str(tmp_path / "v"))
    found = [vector_index.search(spark, str(tmp_path / "v"), q, 20, None) for q in queries[:4]]
    assert sum(recall(f.collect(), search.vector_top_k(rows, q, 20, None).collect()) for f, q in zip(found, queries, strict=False)) / 4 >= 0.9
    n = vector_index.lists_of(spark, str(tmp_path / "v")).select("list").distinct().count()
    assert n > 20 and all(files_read(f)[None] <= 0.5 * n for f in found)


def test_recall_on_test_tables(spark, tmp_path):
    if not os.path.isdir(f"{DATA}/sf0.1"):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").selectExpr("cast(vec_id as string) AS entity_id", "'function' AS entity_type", "embedding")
    vector_index.build(rows, str(tmp_path / "v"))
    queries = [r.embedding for r in rows.filter("cast(entity_id as int) % 250 = 0").collect()]
    assert sum(recall(vector_index.search(spark, str(tmp_path / "v"), q, 20).collect(), search.vector_top_k(rows, q, 20).collect()) for q in queries) / len(queries) >= 0.9
    assert spark.read.parquet(str(tmp_path / "v" / "centres")).first().share < 1


def test_the_index_serves_until_vectors_change(spark, vectors, tmp_path):
    rows, queries = vectors
    s = store.Store(spark, str(tmp_path / "s"), buckets=4)
    assert s.vector_top_k(queries[0], 5).count() == 0
    s.build_vector_index()  # nothing to index
    s.write({"embeddings": rows})
    s.build_vector_index(lists=8)
    assert "vector_lists" in s.vector_top_k(queries[0], 5).inputFiles()[0]
    s.write({"files": frame(spark, "files", [{"id": "x", "path": "x"}])})
    assert "vector_lists" in s.vector_top_k(queries[0], 5).inputFiles()[0]
    s.upsert("embeddings", frame(spark, "embeddings", [{"entity_id": "new", "entity_type": "function", "embedding": queries[0]}]))
    assert s.vector_top_k(queries[0], 1).first().entity_id == "new"
    s.build_vector_index()
    assert s.vector_top_k(queries[0], 1, probed=None).first().entity_id == "new"
