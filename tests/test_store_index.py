"""What the store derives from its tables: posting lists of grams, and edges by their targets."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import graph, gram_index, search, store
from tests.test_operators import frame

FILES = [f"src/{d}/{n}{i}.ts" for d in ("auth", "user", "cart") for n, i in zip(("login", "logout", "session", "refresh"), range(4))]


def files_read(df):
    """Files that a finished query's scans read, by table of the store."""
    out = {}

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        if name.startswith("Scan parquet"):
            path = plan.relation().location().rootPaths().mkString(",") + "/"
            key = next((t for t in ("function_grams", "file_grams", "relationships_in", "functions", "files", "relationships") if f"/data/{t}/" in path), None)
            out[key] = out.get(key, 0) + plan.metrics().apply("numFiles").value()
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def function_rows(rng, files):
    names = ["load", "saveUser", "refresh_token", "a%b", "checkÄrger", "x", "in", "parseHTML"]
    return [
        {"id": f"{f}:{i}", "name": (n := rng.choice(names) + str(i)), "full_name": f"mod.{n}", "file_id": f, "start_line": i, "doc_comment": rng.choice([None, "", "Loads the session\nof a USER", "nothing", "tok en"]), "signature": "()", "is_exported": True}
        for f in files for i in range(5)
    ]


def file_rows(files):
    return [{"id": f, "path": f, "language": "typescript", "token_count": 1, "is_test": False} for f in files]


@pytest.fixture
def filled(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"), buckets=8)
    s.write({"files": frame(spark, "files", file_rows(FILES)), "functions": frame(spark, "functions", function_rows(random.Random(1), FILES))})
    return s


QUERIES = ["refresh token", "in", "zzzzqqq", "_oad a%b", "ärger login", "%"]


def same_as_scan(s):
    for q in QUERIES:
        assert s.search_functions(q, 15).collect() == search.search_functions(s.table("functions"), q, 15).collect(), q
        assert s.search_files(q, 15).collect() == search.search_files(s.table("files"), q, 15).collect(), q


def test_search_by_grams_is_the_scan(spark, filled, monkeypatch):
    same_as_scan(filled)
    monkeypatch.setattr(gram_index, "SCAN_SHARE", 1.0)  # the index for all that it can answer
    same_as_scan(filled)


def test_the_index_follows_changes(spark, filled, monkeypatch):
    monkeypatch.setattr(gram_index, "SCAN_SHARE", 1.0)
    one = [{"id": f"{FILES[0]}:9", "name": "zzzzqqq", "full_name": "zzzzqqq", "file_id": FILES[0], "start_line": 1}]
    filled.upsert("functions", frame(spark, "functions", one))
    assert [r.id for r in filled.search_functions("zzzzqqq").collect()] == [f"{FILES[0]}:9"]
    same_as_scan(filled)
    filled.delete_files(frame(spark, "files", file_rows(FILES[:3])).select("id"))
    assert filled.search_functions("zzzzqqq").count() == 0
    same_as_scan(filled)


def test_a_lookup_reads_few_files(spark, tmp_path):
    """A rare word: of the index only the parts of its rarest grams, of the functions only the bucket that has it."""
    files = [f"src/m{i}/file{i}.ts" for i in range(400)]
    s = store.Store(spark, str(tmp_path / "index"), buckets=16)
    rows = [{"id": f"{f}:run", "name": "run", "full_name": "run", "file_id": f, "start_line": 1, "doc_comment": f"common words {i}"} for i, f in enumerate(files)] + [{"id": f"{files[7]}:needle", "name": "findNeedle", "full_name": "findNeedle", "file_id": files[7], "start_line": 2}]
    s.write({"files": frame(spark, "files", file_rows(files)), "functions": frame(spark, "functions", rows)})
    found = s.search_functions("needle")
    assert [r.name for r in found.collect()] == ["findNeedle"]
    assert files_read(found)["functions"] == 1
    everything = s.table("functions").filter("name = 'findNeedle'")
    everything.collect()
    assert files_read(everything)["functions"] == 16
    seen = []
    lists = gram_index.candidates(lambda grams: seen.append(len(grams)) or spark.createDataFrame([], "gram string, n int, ids array<string>, of_bucket int"), 100, ["needle"])
    assert seen == [4, 4] and lists.count() == 0  # nee, eed, edl, dle are counted; no lists are read of what isn't there


# --- edges both ways


def edges(rng, files, n):
    return [{"id": f"r{i}", "source_id": rng.choice(files), "target_id": rng.choice(files), "relation_type": "imports"} for i in range(n)]


def test_edges_by_both_ends(spark, tmp_path):
    rng = random.Random(3)
    files = [f"src/f{i}.ts" for i in range(60)]
    s = store.Store(spark, str(tmp_path / "index"), buckets=16)
    s.write({"files": frame(spark, "files", file_rows(files)), "relationships": frame(spark, "relationships", edges(rng, files, 80))})

    def check():
        rows = s.table("relationships")
        assert sorted(r.id for r in s.table("relationships").collect()) == sorted(r.id for r in s._table(s.manifest(), "relationships_in").collect())
        for f in files[:6]:
            found = s.relationships_of(f)
            assert sorted(r.id for r in found.collect()) == sorted(r.id for r in store.relationships_of(rows, f).collect())
            read = files_read(found)
            assert read.get("relationships", 0) <= 1 and read.get("relationships_in", 0) <= 1
        flat = rows.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "id")
        for depth in (1, 3):
            assert sorted(map(tuple, s.neighbours(files[0], depth).collect())) == sorted(map(tuple, graph.neighbours(flat, files[0], depth).collect()))

    check()
    s.upsert("relationships", frame(spark, "relationships", [{"id": "r1", "source_id": files[0], "target_id": files[1], "relation_type": "imports"}, {"id": "new", "source_id": files[2], "target_id": files[0], "relation_type": "calls"}, {"id": "self", "source_id": files[3], "target_id": files[3], "relation_type": "calls"}]))
    check()
    s.delete_files(frame(spark, "files", file_rows(files[2:5])).select("id"))
    check()
    s.write({"relationships": s.table("relationships").limit(0)})
    check()


def test_postings_shuffle_rows_only(spark):
    """Grams are taken after the only shuffle, and a list for each gram of a slice has the ids of a list of the whole bucket."""
    rows = frame(spark, "functions", function_rows(random.Random(3), FILES)).withColumn("bucket", F.lit(1))
    fields = gram_index.SOURCES["functions"][1]
    found = gram_index.postings(rows, fields, 1)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]


def test_slices_of_a_bucket(spark, tmp_path, monkeypatch):
    """Lists of slices answer as the scan does, and together hold what one list holds."""
    monkeypatch.setattr(gram_index, "SCAN_SHARE", 1.0)
    rows, fields = frame(spark, "functions", function_rows(random.Random(4), FILES)), gram_index.SOURCES["functions"][1]
    held = lambda: sorted((r.gram, i) for r in gram_index.postings(rows.withColumn("bucket", F.lit(1)), fields, 1).collect() for i in r.ids)
    whole = held()
    monkeypatch.setattr(gram_index, "SLICE_ROWS", 4)
    assert held() == whole
    s = store.Store(spark, str(tmp_path / "sliced"), buckets=2)
    s.write({"functions": rows})
    for query in ("load", "session user", "checkÄ", "parse"):
        assert sorted(map(tuple, s.search_functions(query, 1000).collect())) == sorted(map(tuple, search.search_functions(rows, query, 1000).collect()))
