import json
import subprocess
import threading
import time
import urllib.request

import pytest

from cartulary import tools
from cartulary.__main__ import parser, run
from cartulary.api import Engine
from cartulary.operators import index
from cartulary.operators.store import Store
from cartulary.plans.samples import SAMPLES
from cartulary.server import serve
from cartulary.sources import git
from cartulary.sources.graph_json import read_graph
from cartulary.sources.repository import find_files, read_repository
from cartulary.streaming import watch


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in SAMPLES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/token.ts").write_text("export interface Token { id: string }\n")
    (root / "src/__tests__").mkdir()
    (root / "src/__tests__/auth.test.ts").write_text("import { authenticate } from '../auth';\nfunction check() {}\n")
    for skipped in ("node_modules/x.ts", "dist/y.ts", ".hidden/z.ts", "gen/g.ts", "notes.txt"):
        (root / skipped).parent.mkdir(exist_ok=True)
        (root / skipped).write_text("function f() {}")
    (root / ".gitignore").write_text("# built\ngen/\n")
    subprocess.run("git init -q && git -c user.name=a -c user.email=a@b commit -q --allow-empty -m first && git add -A && git -c user.name=a -c user.email=a@b commit -qm second", shell=True, cwd=root, check=True)
    return root


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    e = Engine(spark, str(repo), str(tmp_path_factory.mktemp("store") / "index"))
    assert e.index(semantic=True) == {"new": 6, "errors": 0}
    return e


def test_scan(spark, repo):
    assert find_files(str(repo)) == ["cmd/main.go", "lib/animals.py", "src/auth.ts", "src/calc.rs", "src/token.ts", "src/__tests__/auth.test.ts"]
    assert {r.path for r in read_repository(spark, str(repo)).collect()} == set(find_files(str(repo)))


def test_index_is_incremental(spark, repo, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    first = [(p, t) for p, t in SAMPLES.items()]
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    assert index.index(s, frame(first)) == {"new": 4, "errors": 0}
    assert index.index(s, frame(first)) == {"unchanged": 4, "errors": 0}
    assert index.index(s, frame([*first, ("src/token.ts", "export type Token = string")])) == {"new": 1, "unchanged": 4, "errors": 0}
    assert [r.target_id for r in s.table("relationships").filter("relation_type = 'imports'").collect()] == ["src/token.ts"]  # of an unchanged file
    assert index.index(s, frame(first)) == {"deleted": 1, "unchanged": 4, "errors": 0}
    assert s.table("relationships").filter("relation_type = 'imports'").count() == 0
    changed = [("src/auth.ts", "import './token';\nexport function other() {}\n"), ("src/token.ts", "export class Token extends Base implements A, B {}"), *first[2:]]
    assert index.index(s, frame(changed)) == {"new": 1, "changed": 1, "unchanged": 2, "deleted": 1, "errors": 0}
    assert {r.name for r in s.table("functions").filter("file_id = 'src/auth.ts'").collect()} == {"other"}
    kinds = sorted(r.relation_type for r in s.table("relationships").collect())
    assert kinds == ["extends", "implements", "implements", "imports"]  # a forward import resolves


def test_all_errors_are_counted(spark, tmp_path):
    sources = spark.range(1100).selectExpr("concat('src/f', id, '.ts') AS path", "'x' AS content")
    assert index.index(Store(spark, str(tmp_path / "i")), sources, registry={".py": None}) == {"new": 1100, "errors": 1100}


def test_context(engine):
    c = engine.get_context("How does authentication work?")
    assert c.intent == "Understanding how something works" and "Session.refresh" in c.entities  # session is a synonym
    c = engine.get_context("authenticate")
    assert "authenticate" in c.entities
    assert c.sections[0].title == "Relevant Functions" and c.token_cost > 0 and "Key functions" in c.summary
    none = engine.get_context("xzjklqwerty", semantic=False)
    assert none.sections == [] and none.confidence == 0 and none.summary.startswith("No context found")
    assert engine.get_file_context("src/auth.ts").title == "File: src/auth.ts"
    assert engine.get_file_context("no.ts") is None
    assert engine.find_related("session").summary == ""
    assert engine.get_context("authenticate", max_tokens=1).sections == []
    key = engine.record_feedback(c.id, 5, accepted=["authenticate"])
    assert engine.store.feedback_for(c.id).first().id == key


def test_analytics(spark, engine, tmp_path):
    assert engine.stats()["files"] == 6
    assert "No test files detected" not in {r.name for r in engine.conventions().collect()}
    assert "naming" in engine.convention_summary()
    assert engine.architecture_report().startswith("## Architecture Analysis")
    stats = engine.graph_stats()
    assert stats["edgeTypeBreakdown"]["imports"] == 2 and stats["nodeCount"] > 10
    assert engine.find_path("src/__tests__/auth.test.ts", "src/token.ts") is not None
    (tmp_path / "g.json").write_text(engine.graph_json())
    nodes, edges = read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == stats["nodeCount"] and edges.count() == stats["edgeCount"]


def test_git(spark, engine, repo):
    assert git.is_date("2024-01-01") and git.is_date("2 weeks ago") and not git.is_date("HEAD~3") and not git.is_date("v1.2")
    assert git.clamp(0, 500) == (1, 100)
    with pytest.raises(ValueError, match="neither"):
        git.commits(spark, str(repo), since="--output=/tmp/x")
    found = engine.recent_changes()
    assert [s for _, s in found["commits"]] == ["second", "first"]
    assert "src/auth.ts" in found["files"] and found["indexed"]


def test_command_line(engine, tmp_path):
    out = lambda *args: run(parser().parse_args(list(args)), engine)
    assert out("status").startswith("files: 6")
    assert json.loads(out("context", "authenticate", "-f", "structured"))["sections"]
    assert "Confidence" in out("ask", "where is authenticate")
    assert "[HIGH]" in out("conventions") and json.loads(out("conventions", "-j", "-c", "testing"))
    assert "concepts" in json.loads(out("architecture", "-j"))
    assert "nodeCount" in out("graph", "-s")
    target = tmp_path / "g.dot"
    assert out("graph", "-d", "-o", str(target)).startswith("Written") and target.read_text().startswith("digraph")
    assert "second" in out("what-changed", "-n", "5")
    assert out("init") == "errors=0 unchanged=6"


def test_tools(engine):
    ask = lambda method, **params: tools.answer(engine, {"id": 1, "method": method, "params": params})
    assert len(ask("tools/list")["result"]["tools"]) == 8
    assert "authenticate" in ask("tools/call", name="get_context", arguments={"query": "authenticate"})["result"]["content"][0]["text"]
    assert ask("tools/call", name="get_file_context", arguments={"file_path": "x"})["result"]["content"][0]["text"].startswith("File not found")
    for name, args in (("get_recent_changes", {}), ("detect_conventions", {"category": "naming"}), ("analyze_architecture", {"mode": "modules"}), ("get_graph", {"format": "summary"}), ("index_repo", {})):
        assert "isError" not in ask("tools/call", name=name, arguments=args)["result"], name
    assert ask("tools/call", name="no")["result"]["isError"]
    assert ask("nothing")["error"]["code"] == -32601 and tools.answer(engine, {"method": "x"}) is None
    assert ask("initialize")["result"]["serverInfo"]["name"] == "cartulary"


def test_server(engine):
    s = serve(engine, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}{p}").read().decode()
        assert json.loads(get("/api/health")) == {"status": "ok", "indexed": True}
        assert json.loads(get("/api/stats"))["files"] == 6
        assert "<title>" in get("/")
    finally:
        s.shutdown()
        s.server_close()


def test_watch(spark, tmp_path):
    root = tmp_path / "w"
    (root / "src").mkdir(parents=True)
    (root / "src/_a.py").write_text("def one():\n    pass\n")
    s, seen = Store(spark, str(tmp_path / "s")), []
    q = watch.apply_changes(watch.changes(spark, str(root), existing=True), s, str(tmp_path / "c"), "200 milliseconds", on_batch=lambda n, counts: seen.append(counts))

    def until(names):
        for _ in range(120):
            if q.exception():
                raise q.exception()
            if {r.name for r in s.table("functions").collect()} == names:
                return
            time.sleep(0.5)
        raise AssertionError({r.name for r in s.table("functions").collect()})

    (root / "src/distance.py").write_text("def ignored():\n    pass\n")
    (root / "src/.hidden.py").write_text("def ignored():\n    pass\n")
    try:
        until({"one"})
        (root / "src/b.py").write_text("def two():\n    pass\n")
        (root / "src/_a.py").write_text("def uno():\n    pass\n")
        until({"uno", "two"})
        (root / "src/b.py").unlink()
        until({"uno"})
        while "unlink" not in seen[-1]:  # a batch is told of after it is stored
            time.sleep(0.1)
    finally:
        q.stop()
    assert {k for c in seen for k in c} == {"add", "change", "unlink", "errors"}
