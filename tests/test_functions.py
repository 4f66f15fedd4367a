import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.functions import constants
from cartulary.functions import text as T
from cartulary.sources.ignore import ignored, ignored_py, read_patterns


def value(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_constants():
    assert len(constants.STOP_WORDS) == len(set(constants.STOP_WORDS)) == 80
    assert len(constants.SYNONYMS) == 18


def test_queries_are_normalised_and_expanded():
    assert T.normalize_query_py("How does Auth-work?!") == "how does auth work"
    assert T.expand_query_py("authentication").split()[1:] == ["login", "session", "jwt", "token", "credential", "signin", "signout"]
    assert T.expand_query_py("constructor") == "constructor"
    assert T.keywords_py("how is the a x login") == ["login"]


def test_columns_agree_with_strings(spark):
    queries = ["How does auth work?", "refactor it", "where is x", "explain", "hm", "show workflow", ""]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select("q", T.intent(F.col("q")).alias("i"), T.normalize_query(F.col("q")).alias("n"), T.keywords(F.col("q")).alias("k")).collect()
    for r in rows:
        assert r.i == T.intent_py(r.q)
        assert r.n == T.normalize_query_py(r.q)
        assert r.k == T.keywords_py(r.q)


def test_match_score(spark):
    score = lambda q, exported=False: value(spark, T.match_score(q, F.lit("login"), F.lit("Auth.login"), F.lit("signs in"), F.lit("(a)"), F.lit(exported)))
    assert score("login") == 1.0
    assert score("auth") == pytest.approx(2 / 3)
    assert score("signs") == pytest.approx(1 / 3)
    assert score("signs", True) == pytest.approx(1 / 3 + 0.1)
    assert score("the") == 0.1
    assert score("login auth", True) == pytest.approx(min(5 / 6 + 0.1, 1))


def test_ids_rounding_and_names(spark):
    assert value(spark, T.short_id(F.lit("naming:camelCase-functions"))) == "3e8c26b04cbf"
    assert value(spark, T.round2(F.lit(5 / 6))) == 0.83
    assert value(spark, T.percent(F.lit(0.125))) == 13
    assert value(spark, T.module_name(F.lit("src/user-auth"))) == "User Auth"
    assert value(spark, T.module_name(F.lit("src/v2.api_x"))) == "V2.Api X"
    assert value(spark, T.last_part(F.lit("a:b:c"))) == "c"
    assert value(spark, T.token_estimate(F.lit("12345"))) == 2


def test_case_predicates(spark):
    names = {"getUser": "c", "get": "cs", "Button": "p", "get_user": "s", "get-user": "", "": "", "a\n": ""}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.is_camel(F.col("n")).alias("c"), T.is_pascal(F.col("n")).alias("p"), T.is_snake(F.col("n")).alias("s")).collect()
    for r in rows:
        assert "".join(k for k in "cps" if r[k]) == names[r.n]


def test_embedded_texts(spark):
    assert value(spark, T.function_text(F.lit("f"), F.lit(""), F.lit("doc"))) == "f doc"
    assert value(spark, T.class_text(F.lit("C"), F.array(F.lit("x:m"), F.lit("n")))) == "class C m n"
    assert value(spark, F.length(T.function_text(F.lit("f" * 600), F.lit(""), F.lit("")))) == 512
    assert value(spark, T.dot_product(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(1.0), F.lit(0.5)))) == pytest.approx(1.0)
    assert value(spark, T.html_escape(F.lit('<a b="c&">'))) == "&lt;a b=&quot;c&amp;&quot;&gt;"


GLOBS = [
    ("*.log", "a.log", True), ("*.log", "x/y/a.log", True), ("*.log", "a.log.txt", False), ("build/", "build/x.ts", True), ("build/", "src/build/x.ts", True), ("docs/*.md", "docs/a.md", True), ("docs/*.md", "docs/x/a.md", False),
    ("docs/**", "docs/x/a.md", True), ("src/gen/", "src/gen/a.ts", True), ("src/gen/", "x/src/gen/a.ts", False), ("/foo", "foo", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("x+y", "x+y", True), ("[ab]", "a", False),
]


def test_globs(spark):
    assert read_patterns("# no\n\n*.log \n!keep\nbuild/") == ["*.log", "build/"]
    for pattern, path, expected in GLOBS:
        assert ignored_py(path, [pattern]) is expected, (pattern, path)
        assert value(spark, ignored(F.lit(path), [pattern])) is expected


@given(st.text(alphabet="ab/.*?", max_size=8), st.text(alphabet="ab/.", max_size=8))
def test_globs_without_wildcards_are_exact(pattern, path):
    if "*" not in pattern and "?" not in pattern and "/" in pattern.rstrip("/") and not pattern.endswith("/"):
        assert ignored_py(path, [pattern]) == (path == pattern)
    assert isinstance(ignored_py(path, [pattern]), bool)
