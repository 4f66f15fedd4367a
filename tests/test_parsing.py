import pytest
from pyspark.sql import functions as F

from cartulary.operators import parsing
from cartulary.operators.parsing import go, python, python_ast, rust, typescript
from cartulary.plans.samples import SAMPLES

TS, PY, GO, RS = SAMPLES["src/auth.ts"], SAMPLES["lib/animals.py"], SAMPLES["cmd/main.go"], SAMPLES["src/calc.rs"]


def by(rows, key="name"):
    return {r[key]: r for r in rows}


def test_typescript_sample():
    p = typescript.parse("src/auth.ts", TS)
    f = by(p.functions, "full_name")
    assert set(f) == {"authenticate", "add", "Session.refresh", "Session.close"}
    a = f["authenticate"]
    assert a["signature"] == "(user: string, password: string) => Promise<boolean>"
    assert (a["complexity"], a["is_exported"], a["is_async"], a["start_line"], a["end_line"]) == (5, True, True, 7, 13)
    assert a["doc_comment"] == "Checks a password."
    assert f["add"]["signature"] == "(a: number, b: unknown) => number"
    assert f["Session.refresh"]["signature"].startswith("((destructured): {")
    c = p.classes[0]
    assert c["methods"] == ["src/auth.ts:Session.refresh", "src/auth.ts:Session.close"]
    assert (c["properties"], c["extends_id"], c["implements_ids"], c["is_exported"]) == (["id"], "src/auth.ts:Base", ["src/auth.ts:Closable"], True)
    assert [(t["name"], t["kind"], t["properties"]) for t in p.types] == [("Options", "interface", ["name", "limit"]), ("Id", "type", []), ("Role", "enum", ["Admin", "User"])]
    assert p.imports == ["./token", "../util/helper"]


@pytest.mark.parametrize(
    ("source", "complexity"),
    [("function f() { if (a) {} else if (b) {} for (;;) {} }", 4), ("function f() { do { x(); } while (y); }", 2), ("function f() { const r = /if (x)/; return 'for (' + `while (${a ? 1 : 2})`; }", 1), ("function f(a?: number) { return a?.b ?? (a ? 1 : 2); }", 2), ("function f() { try {} catch (e) {} switch (x) { case 1: } // if (\n }", 3)],
)
def test_typescript_complexity(source, complexity):
    assert typescript.parse("a.ts", source).functions[0]["complexity"] == complexity


def test_typescript_forms():
    p = typescript.parse("a.ts", "export default function () {}\nconst x = async y => y, z = function named() {};\nlet g = <T,>(a: T, ...rest: T[]): T => { return a };\nconst o = { m() {}, f: () => 1 };\nimport d, { e } from './d';\nimport './s';\nexport * from './t';\nconst l = import('./lazy');\nexport const enum E { A }\nabstract class B { abstract m(): void; get v() { return 1 } static s = () => 2; ['c'](): void {} }\n")
    f = by(p.functions, "full_name")
    assert {"(anonymous)", "x", "named", "g", "B.m", "B.(anonymous)"} <= set(f)
    assert f["x"]["is_async"] and f["x"]["signature"] == "(y: unknown) => void"
    assert f["g"]["signature"] == "(a: T, rest: T[]) => T"
    assert f["(anonymous)"]["is_exported"] and not f["x"]["is_exported"]
    assert p.imports == ["./d", "./s", "./t"]
    assert p.types == [{"file_id": "a.ts", "name": "E", "kind": "enum", "properties": ["A"]}]
    assert by(p.classes)["B"]["properties"] == ["s"]
    assert by(typescript.parse("a.ts", "export const h = () => 1;", export_arrows=True).functions)["h"]["is_exported"]


def test_python_sample():
    p = python.parse("lib/animals.py", PY)
    f = by(p.functions)
    assert f["speak"]["signature"] == "(name: str, times: int) -> str"
    assert (f["speak"]["start_line"], f["speak"]["end_line"], f["speak"]["complexity"], f["speak"]["doc_comment"]) == (4, 8, 3, "Says it.")
    assert f["fetch"]["is_async"] and not f["speak"]["is_async"]
    dog = by(p.classes)["Dog"]
    assert (dog["extends_id"], dog["implements_ids"], dog["methods"]) == ("lib/animals.py:Animal", ["lib/animals.py:Loud"], ["lib/animals.py:Dog.bark"])
    assert [t["name"] for t in p.types] == ["Point"]
    shifted = by(python.parse("a.py", PY, parity=True).functions)["speak"]
    assert shifted["start_line"] == 2  # blank lines taken by the pattern
    assert python.parse("a.py", "def _x():\n    pass").functions[0]["is_exported"] is False
    assert python.parse("a.py", "def f():\n    '''a\n    b'''\n    pass").functions[0]["doc_comment"] == "a\nb"


def test_python_tree():
    f = by(python_ast.parse("a.py", PY).functions)
    assert set(f) == {"speak", "fetch"}
    assert f["speak"]["signature"] == "(name: str, times: int) -> str"
    with pytest.raises(SyntaxError):
        python_ast.parse("a.py", "def (")


def test_go_sample():
    p = go.parse("cmd/main.go", GO)
    f = by(p.functions)
    assert f["NewUser"]["is_exported"] and not f["rename"]["is_exported"]
    assert f["rename"]["full_name"] == "u.User.rename"
    assert (f["NewUser"]["doc_comment"], f["NewUser"]["complexity"]) == ("NewUser makes one.", 2)
    assert by(p.classes)["User"]["properties"] == ["ID", "Name"]
    assert {(t["name"], t["kind"]) for t in p.types} >= {("User", "type"), ("Store", "interface")}
    assert go.parse("a.go", "type A = int\ntype B int\n").types == [{"file_id": "a.go", "name": "B", "kind": "type-alias", "properties": []}]


def test_rust_sample():
    p = rust.parse("src/calc.rs", RS)
    f = by(p.functions)
    assert f["run"]["full_name"] == "Calculator::run" and f["run"]["is_async"]
    assert (f["add"]["doc_comment"], f["add"]["is_exported"], f["add"]["signature"]) == ("Adds.", True, "fn add(a: i32, b: i32) -> i32")
    assert by(p.classes)["Calculator"]["properties"] == ["value", "name"]
    kinds = {t["name"]: (t["kind"], t["properties"]) for t in p.types}
    assert kinds["Kind"] == ("enum", ["One", "Two"]) and kinds["Shape"] == ("interface", ["area"])
    assert by(rust.parse("a.rs", "struct P(i32, pub u8);").classes)["P"]["properties"] == ["i32", "pub u8"]


def test_braces_in_strings_and_comments_do_not_count():
    f = by(go.parse("a.go", 'package a\n\n// not this\n\nvar x = 1\n\n// F\n/* { */\n// says }\nfunc F() string {\n\t// }\n\tif is(x) { return "}" }\n\treturn `\n}`\n}\n\nfunc g() {}\n').functions)
    assert (f["F"]["start_line"], f["F"]["end_line"], f["F"]["doc_comment"]) == (10, 15, "F\nsays }")
    assert (f["g"]["start_line"], f["g"]["doc_comment"]) == (17, "")
    f = by(rust.parse("a.rs", "impl<T> Shape for Box<T> {\n    /// Size.\n    fn size(&self) -> char {\n        let s = \"}\"; // }\n        if s == r#\"{\"#  { '}' } else { '{' }\n    }\n}\n\nmod inner {\n    fn free() {}\n}\nfn after();\nstruct Unit;\nstruct Next { a: i32 }\n").functions)
    assert (f["size"]["full_name"], f["size"]["end_line"], f["size"]["doc_comment"], f["size"]["complexity"]) == ("Shape::size", 6, "Size.", 2)
    assert f["free"]["full_name"] == "free" and f["after"]["end_line"] == 12
    assert [c["properties"] for c in rust.parse("a.rs", "struct Unit;\nstruct Next { a: i32 }\nstruct More {\n    // no: x\n    b: u8,\n}\n").classes] == [[], [], ["b"]]


def test_python_blocks():
    p = python.parse("a.py", "class A:\n    def f(self):\n        if x:\n            pass\n\n        return 1\n\n    def g(self):\n        \"\"\"One line.\"\"\"\n\n\nx = 1\n")
    assert [(f["name"], f["start_line"], f["end_line"], f["doc_comment"]) for f in p.functions] == [("f", 2, 6, ""), ("g", 8, 9, "One line.")]
    assert p.classes[0]["methods"] == ["a.py:A.f", "a.py:A.g"]


@pytest.mark.parametrize("parse", [typescript.parse, python.parse, go.parse, rust.parse])
@pytest.mark.parametrize("source", ["", "\n\n", "{{{ ((( '", "function class def fn struct `${", "}\n)\n]"])
def test_odd_sources_do_not_fail(parse, source):
    parse("x", source)


def test_sources_to_tables(spark):
    rows = spark.createDataFrame([*SAMPLES.items(), ("bad.py", None), ("x.unknown", "a"), ("dup.py", "def a():\n    pass\ndef a():\n    return 1\n")], "path string, content string")
    parsed = parsing.parse_sources(rows, parsing.tree_registry()).persist()
    assert {r.path for r in parsed.filter("error is not null").collect()} == {"x.unknown"}
    found = parsing.entities(parsed)
    ids = [r.id for r in found["functions"].select("id").collect()]
    assert len(ids) == len(set(ids)) and "dup.py:a" in ids
    assert found["functions"].filter("id = 'dup.py:a'").first().start_line == 3
    assert {(r.from_path, r.spec) for r in found["imports"].collect()} == {("src/auth.ts", "./token"), ("src/auth.ts", "../util/helper")}
    files = parsing.file_rows(rows.filter("content is not null")).select("path", "language", "is_test", F.length("content_hash").alias("n")).collect()
    assert {r.path: r.language for r in files}["src/calc.rs"] == "rust"
    assert all(r.n == 64 for r in files)
    tests = spark.createDataFrame([("a.test.ts",), ("a.spec.tsx",), ("test_x.py",), ("x_test.go",), ("tests/a.rs",), ("a.go",)], "path string").select("path", parsing.is_test(F.col("path")).alias("t"))
    assert {r.path for r in tests.filter("t").collect()} == {"a.test.ts", "test_x.py", "x_test.go", "tests/a.rs"}
