import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartulary.llm import decontaminate, host_rules, minhash, mixing, stages
from cartulary.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def keys(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(root / "documents.parquet"))
    items = [(1, docs.filter("doc_id = 90").first().text)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mixing", "token ids"]


def test_each_stage(spark, wide, folder):
    out = stages.quality_rules(spark, wide, folder)
    kept = host_rules.host_rules(wide).filter("kept")
    assert out.columns == wide.columns and sorted(r.doc_id or -1 for r in out.collect()) == sorted(r.doc_id or -1 for r in kept.collect())

    out = stages.near_duplicate(spark, wide, folder)
    groups = minhash.near_duplicates(wide, 5).filter("kept").select("doc_id", "row").distinct()
    assert out.columns == wide.columns and out.count() == groups.count()
    assert len(keys(out)) == len(set(keys(out)))  # of rows that repeat one stays

    out = stages.decontamination(spark, wide, folder)
    dirty = decontaminate.decontaminate(wide, spark.read.parquet(f"{folder}/benchmark.parquet")).filter("contaminated")
    assert out.columns == wide.columns and out.count() == wide.count() - dirty.count() < wide.count()
    assert not {r.doc_id for r in out.collect()} & ({r.doc_id for r in dirty.collect()} - {None, 91})

    out = stages.mixing(spark, wide, folder)
    times = mixing.mixture(wide).filter("epochs > 0")
    assert out.columns == wide.columns and out.count() == times.agg(F.sum("epochs")).first()[0]
    assert sorted((r.doc_id or -1) for r in out.collect()) == sorted((r.doc_id or -1) for r in times.collect() for _ in range(r.epochs))


def test_stages_on_nothing(spark, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.n_tokens <= 2048 for r in rows)
    assert 90 not in {d for r in rows for d in r.doc_ids}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    if name in SQL:
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(SMALL):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
        assert rows == sorted(c.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({SQL[name]})").fetchall(), key=repr)
    else:
        assert rows
