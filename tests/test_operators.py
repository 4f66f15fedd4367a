import json
import threading

import random

import pytest
from pyspark.sql import functions as F

from cartulary import schema
from cartulary.operators import architecture, conventions, graph, importing, search, store


def frame(spark, table, rows):
    """Rows of some columns of a table; the others have defaults."""
    kinds = dict(schema._columns(schema.TABLES[table]))
    names = list(rows[0])
    return schema.with_defaults(table, spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names)))


def files_of(spark, *paths, tests=()):
    return frame(spark, "files", [{"id": p, "path": p, "language": "typescript", "token_count": 1, "is_test": p in tests} for p in paths])


def functions_of(spark, *rows):
    return frame(spark, "functions", [{"id": f"{f}:{n}", "name": n, "full_name": n, "file_id": f, "start_line": i, "is_exported": e} for i, (f, n, e) in enumerate(rows)])


# --- search


def test_keyword_search(tables):
    found = search.search_functions(tables["functions"], "authenticate user", 10).collect()
    assert [r.name for r in found] == ["authenticate", "getUser"]
    assert search.search_functions(tables["functions"], "xzjklqwerty").count() == 0
    assert [r.name for r in search.search_functions(tables["functions"], "_etUser", rank="table").collect()] == ["getUser"]  # a wildcard
    assert [r.path for r in search.search_files(tables["files"], "the auth").collect()] == ["src/auth.ts"]


def test_vectors_and_merge(spark, tables):
    top = search.vector_top_k(tables["embeddings"], [0.0, 1.0], 5).collect()
    assert [r.entity_id for r in top] == ["src/user.ts:getUser", "src/auth.ts:authenticate"]
    k = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, pos int")
    v = spark.createDataFrame([("d", 1), ("c", 2), ("a", 3)], "id string, pos int")
    assert [r.id for r in search.hybrid_merge(k, v).collect()] == ["a", "c", "b", "d"]


def test_budget_counts_what_it_drops(spark):
    rows = spark.createDataFrame([(1, 50), (2, 60), (3, 1)], "pos int, tokens int")
    assert [r.kept for r in search.token_budget(rows, 100).orderBy("pos").collect()] == [True, False, False]


def test_context(tables):
    sections, ranked = search.find_context(tables, "authenticate a user")
    rows = sections.orderBy("pos").collect()
    assert [r.title for r in rows] == ["Relevant Functions", "Related Files", "Related Classes", "Related Types"]
    assert "### authenticate\n- **Location:** src/auth.ts:1-20" in rows[0].content
    assert "- **Extends:** Base" in rows[2].content and "refreshToken" in rows[2].content
    assert ranked.count() == 2
    _, hybrid = search.find_context(tables, "authenticate", query_vector=[0.0, 1.0])
    assert [r.name for r in hybrid.orderBy("pos").collect()] == ["authenticate", "getUser"]


def test_file_context(tables):
    r = search.file_context(tables, "src/auth.ts").first()
    assert r.content.startswith("## File: src/auth.ts\n\nLanguage: typescript\nToken count: 200\nIs test: false\n\n### Classes\n\n- Session extends Base\n  - Methods: refreshToken, gone\n")
    assert "- authenticate: (user: string) => boolean\n  - Checks a user.\n" in r.content
    assert search.file_context(tables, "no").count() == 0


# --- store


def test_store(spark, tmp_path, tables):
    s = store.Store(spark, str(tmp_path / "index"))
    assert not s.is_indexed and s.table("files").count() == 0
    s.write({k: tables[k] for k in ("files", "functions", "classes", "types", "relationships", "embeddings")})
    assert s.is_indexed and s.has_embeddings()
    s.upsert("files", files_of(spark, "src/auth.ts").withColumn("content_hash", F.lit("new")))
    assert s.file_by_path("src/auth.ts").first().content_hash == "new" and s.table("files").count() == 2
    assert s.function_by_id("src/user.ts:getUser").count() == 1
    s.delete_embeddings(spark.createDataFrame([("src/user.ts",)], "id string"))
    assert s.table("embeddings").count() == 2
    s.delete_files(spark.createDataFrame([("src/auth.ts",)], "id string"))
    assert {r.entity: r.n for r in s.stats().collect()} == {"files": 1, "functions": 1, "classes": 0, "types": 1, "relationships": 0}
    row = [("f1", "q", "c", 5, ["a"], [], None)]
    s.insert_feedback(spark.createDataFrame(row, schema.FEEDBACK))
    assert s.feedback_for("c").count() == 1
    with pytest.raises(ValueError, match="exists"):
        s.insert_feedback(spark.createDataFrame(row, schema.FEEDBACK))
    with pytest.raises(Exception, match="check of feedback"):
        s.insert_feedback(spark.createDataFrame([("f2", "q", "c", 6, [], [], None)], schema.FEEDBACK))
    assert s.versions() == [1, 2, 3, 4, 5]
    (tmp_path / "index" / "versions" / "6").write_text(json.dumps(s.manifest() | {"schema": schema.SCHEMA_VERSION - 1, "version": 6}))
    assert not s.is_indexed  # another schema version counts as empty


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"), buckets=16)
    paths = [f"src/f{i}.ts" for i in range(60)]
    s.write({"files": files_of(spark, *paths)})
    first = s.manifest()["tables"]["files"]
    s.upsert("files", files_of(spark, paths[7]).withColumn("content_hash", F.lit("new")))
    then = s.manifest()["tables"]["files"]
    assert first.keys() == then.keys() and sum(first[b] != then[b] for b in first) == 1
    assert s.table("files").count() == 60 and s.file_by_path(paths[7]).first().content_hash == "new"
    (at,) = {change for b, change in then.items() if change != first[b]}
    assert sum(len(list(x.glob("part-*"))) for x in (tmp_path / "index/data/files" / at).iterdir() if x.is_dir()) == 1
    s.delete_files(spark.createDataFrame([(paths[7],)], "id string"))
    assert s.table("files").count() == 59


def test_a_manifest_is_never_written_over(spark, tmp_path):
    a, b = (store.Store(spark, str(tmp_path / "index")) for _ in range(2))
    a.write({"files": files_of(spark, "a.ts")})
    late = b.manifest() | {"version": 1}
    with pytest.raises(RuntimeError, match="another writer"):
        b._publish(late)
    assert a.versions() == [1] and a.table("files").count() == 1


def test_readers_see_whole_versions(spark, tmp_path):
    s, other, seen, stop = store.Store(spark, str(tmp_path / "index")), store.Store(spark, str(tmp_path / "index")), [], threading.Event()
    s.write({"files": files_of(spark, "a.ts", "b.ts").withColumn("content_hash", F.lit("-"))})

    def read():
        while not stop.is_set():
            seen.append(sorted(r.content_hash for r in other.table("files").collect()))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(6):
            s.write({"files": files_of(spark, "a.ts", "b.ts").withColumn("content_hash", F.lit(str(i)))})
    finally:
        stop.set()
        reader.join()
    assert len(seen) > 3 and all(len(x) == 2 and len(set(x)) == 1 for x in seen)


def test_old_versions_are_deleted(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    for i in range(4):
        s.write({"files": files_of(spark, "a.ts").withColumn("content_hash", F.lit(str(i)))})
    s.vacuum(kept=1)
    assert s.versions() == [3, 4] and len([x for x in (tmp_path / "index/data/files").iterdir()]) == 2
    assert s.file_by_path("a.ts").first().content_hash == "3"


def test_diff_and_latest(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, content_hash string")
    b = spark.createDataFrame([("y", "2"), ("z", "0"), ("w", "9")], "path string, content_hash string")
    assert {r.path: r.status for r in store.diff(a, b, deleted=True).collect()} == {"x": "new", "y": "unchanged", "z": "changed", "w": "deleted"}
    assert {r.status: r.n for r in store.progress(store.diff(a, b)).collect()} == {"new": 1, "unchanged": 1, "changed": 1}
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, None), ("k", 2, "c")], "id string, seq int, v string")
    assert [tuple(r) for r in store.latest(rows, ["id"], "seq").collect()] == [("k", 3, None)]


# --- conventions


def found(df):
    return {r.name: r for r in df.collect()}


def test_naming(spark):
    rows = [("a.ts", n, e) for n, e in (("getUser", True), ("setUser", True), ("x", True), ("loadAll", True), ("save", False), ("Button", True))]
    out = found(conventions.naming(functions_of(spark, *rows)))
    assert out["camelCase function names"].confidence == 0.83
    assert "PascalCase function names" not in out
    assert out["Exported functions use camelCase"].confidence == 0.8
    assert out["camelCase function names"].examples == ["getUser", "setUser", "x", "loadAll", "save"]
    assert conventions.naming(functions_of(spark, *rows).limit(0)).count() == 0


def test_file_rules(spark):
    f = files_of(spark, "src/a/index.ts", "src/b/index.ts", "src/c/index.ts", "packages/x/y.ts", "packages/x/__tests__/y.test.ts", "docs/a.md", "scripts/b.ts", "pnpm-lock.yaml", "turbo.json", tests=("packages/x/__tests__/y.test.ts",))
    out = found(conventions.detect(functions_of(spark, ("a", "f", False)), f))
    assert out["Barrel export files (index.ts)"].confidence == 0.3
    assert out["Monorepo package structure"].confidence == 0.1
    assert out["Barrel export pattern"].confidence == 0.6
    assert {"pnpm package manager", "Turborepo monorepo", "Documentation in docs/", "Build/tool scripts in scripts/", "Test files use .test.ts suffix"} <= set(out)
    assert "Co-located test files" not in out and "Source code in src/ directory" not in out and "Export visibility" not in out
    counts = {r.category: r.conventions for r in conventions.file_counts(conventions.detect(functions_of(spark, ("a", "f", False)), f)).collect()}
    assert counts["directory"] == 4
    none = conventions.testing(files_of(spark, "src/a.ts")).collect()
    assert [(r.name, r.confidence) for r in none] == [("No test files detected", 1.0)]
    src = found(conventions.file_structure(files_of(spark, "src/a.ts", "src/b.ts", "src/c.ts", "x.ts")))
    assert src["Source code in src/ directory"].examples == ["src/a.ts", "src/b.ts"]


# --- architecture


def test_modules(spark):
    f = files_of(spark, "src/auth/a.ts", "src/auth/b.ts", "src/auth/c.ts", "src/payment/a.ts", "src/payment/b.ts", "src/lonely/a.ts", "root.ts", "packages/core/src/a.ts", "packages/core/src/b.ts")
    fn = functions_of(spark, ("src/auth/a.ts", "shared", True), ("src/auth/b.ts", "shared", True), ("src/auth/c.ts", "other", True), ("src/payment/a.ts", "pay", True), ("src/payment/b.ts", "useShared_", False), ("packages/core/src/a.ts", "z", True))
    rel = frame(spark, "relationships", [{"id": "1", "source_id": "src/auth/a.ts", "target_id": "src/payment/a.ts", "relation_type": "imports"}, {"id": "2", "source_id": "src/auth/a.ts", "target_id": "src/auth/b.ts", "relation_type": "imports"}])
    out = {r.root_path: r for r in architecture.modules(f, fn, rel).collect()}
    assert set(out) == {"src/auth", "src/payment", "packages/core", "packages/core/src"}
    auth = out["src/auth"]
    assert len(auth.files) == 3 and auth.exports == ["other", "shared"] and auth.imports == ["src/payment/a.ts"]
    assert auth.cohesion == 0.33 and auth.coupling == 0.67  # useShared_ mentions shared
    assert out["src/payment"].coupling == 0.0
    assert out["packages/core"].sub_modules == ["packages/core/src"]
    assert "#### Auth" in architecture.report(list(out.values()), architecture.concepts(f).collect())


def test_concepts(spark):
    f = files_of(spark, "src/services/a.ts", "src/services/b.ts", "src/api/a.ts", "src/api/b.ts", "src/x/user-factory.ts", "src/x/b-factory.ts")
    layers = {r.name: r.confidence for r in architecture.layers(f).collect()}
    assert layers == {"Business Logic Layer": 0.24, "API Layer": 0.24}
    p = architecture.patterns(f).collect()
    assert [(r.name, round(r.confidence, 3)) for r in p] == [("Factory Pattern", 0.667)]
    g = files_of(spark, "src/user-auth/a.ts", "src/user-auth/b.ts")
    assert {r.name: r.related_files for r in architecture.domains(g).collect()} == {"Auth Domain": ["src/user-auth/a.ts", "src/user-auth/b.ts"], "User Domain": ["src/user-auth/a.ts", "src/user-auth/b.ts"]}


# --- graph


def test_graph(tables):
    n = graph.nodes(tables)
    e = graph.edges(tables, n)
    counts = {(r.kind, r.type): r.n for r in graph.stats(n, e).collect()}
    assert counts[("node", None)] == 7 and counts[("edge", "has_function")] == 3
    assert counts[("edge", "has_method")] == 1 and counts[("edge", "imports")] == 1 and ("edge", "extends") not in counts
    assert graph.edges(tables, n, parity=True).filter("type = 'imports'").count() == 2
    assert graph.average_degree(graph.stats(n, e)).first()[0] == pytest.approx(int(2 * 7 / 7 * 100 + 0.5) / 100)
    near = {r.id: r.distance for r in graph.neighbours(e, "src/auth.ts:authenticate", 2).collect()}
    assert near == {"src/auth.ts": 1, "src/auth.ts:refreshToken": 2, "src/auth.ts:Session": 2, "src/user.ts": 2}
    assert graph.neighbours(e, "nowhere", 2).count() == 0
    assert len(graph.shortest_path(e, "src/auth.ts:authenticate", "src/user.ts:getUser")) == 3
    assert graph.shortest_path(e, "a", "a") == [] and graph.shortest_path(e, "src/auth.ts", "nowhere") is None
    c = graph.clusters(n, e).collect()
    assert [(r.name, r["size"]) for r in c] == [("src", 7)]
    kept, inside = graph.of_types(n, e, ["file"], 500)
    assert kept.count() == 2 and inside.count() == 1
    assert graph.radial_layout(n).count() == 7
    dot = graph.to_dot(n, e)
    assert dot.startswith("digraph KnowledgeGraph {") and '"src/auth.ts" [label="auth.ts", fillcolor="lightblue"];' in dot
    assert '"totalNodes": 7' in graph.to_json(n, e)


def test_long_paths(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}", f"e{i:03d}") for i in range(70)] + [("n000", "n000", "loop"), ("n002", "n000", "f"), ("other", "n999", "g")]
    e = spark.createDataFrame(rows, "source string, target string, id string")
    assert graph.shortest_path(e, "n000", "n070") == ["f", *(f"e{i:03d}" for i in range(2, 70))]
    assert graph.shortest_path(e, "other", "n070") is None
    assert graph.shortest_path(e, "n000", "n004", max_depth=2) is None


def test_types_take_the_place_of_classes(spark, tables):
    both = tables | {"types": frame(spark, "types", [{"id": "src/auth.ts:Session", "name": "Session", "kind": "type", "file_id": "src/auth.ts"}])}
    assert {r.id: r.type for r in graph.nodes(both).collect()}["src/auth.ts:Session"] == "type"
    assert graph.nodes(both, type_wins=False).filter("id = 'src/auth.ts:Session'").count() == 2


def test_components_against_union_find(spark):
    rng = random.Random(3)
    ids = [f"n{i:02d}" for i in range(40)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(28)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    parent = {x: x for x in ids + [f"c{i}" for i in range(31)]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    n = spark.createDataFrame([(x,) for x in parent], "id string")
    e = spark.createDataFrame([(a, b, str(i)) for i, (a, b) in enumerate(pairs)], "source string, target string, id string")
    assert {r.id: r.component for r in graph.components(n, e).collect()} == {x: find(x) for x in parent}


# --- imports


def test_import_resolution(spark):
    f = files_of(spark, "src/a.ts", "src/util/index.ts", "src/util.tsx", "lib/b.js", "lib/x.js.ts", "top.ts")
    rows = [("src/a.ts", "./util"), ("src/a.ts", "../lib/b.js"), ("src/a.ts", "../lib/../src/./util/index"), ("src/a.ts", "react"), ("src/a.ts", "./none"), ("top.ts", "./src/util"), ("src/a.ts", "../lib/x.js")]
    out = {(r.from_path, r.spec): r.to_path for r in importing.resolve(spark.createDataFrame(rows, "from_path string, spec string"), f).collect()}
    assert out == {("src/a.ts", "./util"): "src/util.tsx", ("src/a.ts", "../lib/b.js"): "lib/b.js", ("src/a.ts", "../lib/../src/./util/index"): "src/util/index.ts", ("top.ts", "./src/util"): "src/util.tsx", ("src/a.ts", "../lib/x.js"): "lib/x.js.ts"}


def test_mentions_of_names_of_any_length(spark):
    import itertools
    import re

    from cartulary.operators.mentions import mentions

    words = ["a", "ab", "abc", "a_b", "_", "__", "%", "a%c", "a\\b", "zz", "user_id", "é", "xy_"]
    fields = ["", "a", "ab", "abc", "a\\b", "axb user-id", "é", "nothing of it", "wxyz"]
    texts = [t for t in itertools.product(fields, fields[:3], fields[3:5])]
    names = spark.createDataFrame([(w,) for w in words], "word string")
    rows = spark.createDataFrame([(str(i), str(i), *t) for i, t in enumerate(texts)], "id string, file_id string, name string, full_name string, doc_comment string")
    found = mentions(names, rows)
    pattern = {w: re.compile(".*" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in w) + ".*", re.DOTALL) for w in words}
    want = sorted((w, t) for w in words for t in texts if any(pattern[w].fullmatch(f) for f in t))
    assert sorted((r.word, texts[int(r.file_id)]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cohesion_counts_files_with_equal_exports(spark):
    import itertools

    from cartulary.operators import architecture

    sets = {"m/x/1": "a", "m/x/2": "a", "m/x/3": "ab", "m/x/4": "ab", "m/x/5": "c", "m/x/6": "", "m/x/7": "abc"}
    members = spark.createDataFrame([("m/x", k, k) for k in sets], "root_path string, file_id string, path string")
    exports = spark.createDataFrame([(k, c) for k, v in sets.items() for c in v], "file_id string, full_name string")
    similar = [len(a & b) / len(a | b) if a | b else 0 for a, b in itertools.combinations([set(v) for v in sets.values()], 2)]
    assert architecture.cohesion(members, exports).first().cohesion == pytest.approx(sum(similar) / len(similar))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_middle_path(spark, n):
    from cartulary.operators.ordinals import middle

    paths = sorted(f"src/{i:03}" for i in range(n))
    assert middle(spark.createDataFrame([(p,) for p in paths[::-1]], "path string"), "path") == (paths[n // 2] if n else None)
