"""Queries over the views of a folder of tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.functions.constants import DOMAINS, LAYERS, PATTERNS
from cartulary.functions.text import expand_query_py, intent, keywords_py, module_name, normalize_query_py, short_id, token_estimate
from cartulary.operators import architecture, conventions, graph, importing, search, store
from cartulary.operators.ordinals import numbered
from cartulary.plans.views import Views, duckdb_ctes
from cartulary.scratch import new_path
from cartulary.sources.ignore import ignored

QUERY = "Where is the steel bolt in search?"
#: Words of functions and of paths; sections of all four kinds come out.
FILES_QUERY = "explain the standard parts of the order factory"
BUDGET = 4000
TEXT = expand_query_py(normalize_query_py(QUERY))
WORDS = keywords_py(TEXT)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Views under its name, with its SQL."""
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _tables(v: Views) -> dict[str, DataFrame]:
    return {"files": v["v_files"], "functions": v["v_functions"], "classes": v["v_classes"], "types": v["v_types"]}


def _like(columns: list[str], words: list[str]) -> str:
    return " OR ".join(f"{c} ILIKE '%{w}%'" for w in words for c in columns)


def _score(words: list[str]) -> str:
    points = " + ".join(
        f"(CASE WHEN contains(lower(name), '{w}') THEN 3.0 WHEN contains(lower(full_name), '{w}') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(doc_comment), '{w}') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(signature), '{w}') THEN 0.5 ELSE 0.0 END)" for w in words)
    return f"least(CAST({points} AS DOUBLE) / {3.0 * len(words)}::DOUBLE + CASE WHEN is_exported THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)"


def _array(expr: str, order: str) -> str:
    return f"list({expr} ORDER BY {order})"


# --- search -----------------------------------------------------------------------------------------------------------


@query(f"{duckdb_ctes('v_functions')} SELECT id, name, file_id, round({_score(WORDS)}, 9) AS score FROM v_functions WHERE {_like(['name', 'full_name', 'doc_comment'], WORDS)} ORDER BY {_score(WORDS)} DESC, file_id, start_line, id LIMIT 10")
def keyword_search(v: Views) -> DataFrame:
    """The ten functions that fit a query best."""
    return search.search_functions(v["v_functions"], TEXT, 10).select("id", "name", "file_id", F.round("score", 9).alias("score"))


@query(f"{duckdb_ctes('v_functions')} SELECT id, name FROM v_functions WHERE {_like(['name', 'full_name', 'doc_comment'], ['in'])} ORDER BY file_id, start_line, id LIMIT 20")
def keyword_fallback(v: Views) -> DataFrame:
    """A query of stop words alone is looked for as a whole."""
    return search.search_functions(v["v_functions"], "in", 20, rank="table").select("id", "name")


@query(f"{duckdb_ctes('v_files')} SELECT path, language, token_count FROM v_files WHERE {_like(['path'], ['index', 'src1'])} ORDER BY path LIMIT 20")
def file_search(v: Views) -> DataFrame:
    return search.search_files(v["v_files"], "index of src1", 20).select("path", "language", "token_count")


@query(f"{duckdb_ctes('v_files')} SELECT *, running <= {BUDGET} AS kept FROM (SELECT language, path, token_count, CAST(sum(token_count) OVER (PARTITION BY language ORDER BY path) AS BIGINT) AS running FROM v_files)")
def token_budget(v: Views) -> DataFrame:
    """Files of each language in order, with the running token total and whether it fits the budget."""
    rows = v["v_files"].select("language", "path", "token_count", F.col("path").alias("pos"), F.col("token_count").alias("tokens"))
    return search.token_budget(rows, BUDGET, ["language"]).select("language", "path", "token_count", "running", "kept")


@query(f"{duckdb_ctes('v_files')} SELECT path, row_number() OVER w AS place, CAST(sum(token_count) OVER w AS BIGINT) AS running, CAST(sum(CASE WHEN is_test THEN token_count END) OVER w AS BIGINT) AS test_tokens FROM v_files WINDOW w AS (ORDER BY token_count DESC, path ROWS UNBOUNDED PRECEDING)")
def running_tokens(v: Views) -> DataFrame:
    """All files in one order, the largest first, with their place and running totals: one group of all rows."""
    rows = v["v_files"].select("path", "token_count", F.when(F.col("is_test"), F.col("token_count")).alias("of_test"))
    return numbered(rows, [], [F.col("token_count").desc(), F.col("path")], "place", {"running": "token_count", "test_tokens": "of_test"}).select("path", F.col("place").cast("long").alias("place"), "running", "test_tokens")


@query(r"""
SELECT conv_id, turn, CASE
  WHEN contains(t, 'how') AND (contains(t, 'work') OR contains(t, 'flow')) THEN 'Understanding how something works'
  WHEN contains(t, 'refactor') OR contains(t, 'change') OR contains(t, 'modify') THEN 'Planning a change or refactor'
  WHEN contains(t, 'find') OR contains(t, 'search') OR contains(t, 'where') THEN 'Locating code or functionality'
  WHEN contains(t, 'what') OR contains(t, 'explain') OR contains(t, 'describe') THEN 'Getting an explanation or overview'
  ELSE 'General context retrieval' END AS intent, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens
FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)""")
def intent_classify(v: Views) -> DataFrame:
    return v["conversations"].select("conv_id", "turn", intent(F.col("text")).alias("intent"), token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^0-9A-Za-z_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM conversations""")
def normalize(v: Views) -> DataFrame:
    from cartulary.functions.text import normalize_query

    return v["conversations"].select("conv_id", "turn", normalize_query(F.col("text")).alias("normalized"))


@query(f"""{duckdb_ctes('v_vectors')}, q AS (SELECT embedding AS q FROM v_vectors WHERE vec_id = 0)
SELECT entity_id, round(s, 6) AS score FROM (SELECT entity_id, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), lambda x: x[1] * x[2])) AS s FROM v_vectors, q) ORDER BY s DESC, entity_id LIMIT 20""")
def cosine_topk(v: Views) -> DataFrame:
    """The vectors nearest to the first one."""
    q = v["v_vectors"].filter("vec_id = 0").first()
    return search.vector_top_k(v["v_vectors"], list(q.embedding) if q else [], 20).select("entity_id", F.round("score", 6).alias("score"))


@query(f"""{duckdb_ctes('v_functions')},
k AS (SELECT id, row_number() OVER (ORDER BY file_id, start_line, id) AS pos FROM v_functions WHERE {_like(['name', 'full_name', 'doc_comment'], ['steel'])} ORDER BY pos LIMIT 8),
s AS (SELECT id, row_number() OVER (ORDER BY complexity DESC, id) AS pos FROM v_functions WHERE {_like(['name'], ['bolt', 'steel'])} ORDER BY pos LIMIT 8)
SELECT coalesce(k.id, s.id) AS id, CAST(CASE WHEN k.id IS NULL THEN 2 WHEN s.id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS bucket, CAST(k.pos AS BIGINT) AS keyword_pos, CAST(s.pos AS BIGINT) AS vector_pos
FROM k FULL OUTER JOIN s ON k.id = s.id ORDER BY bucket, coalesce(k.pos, s.pos), 1 LIMIT 10""")
def hybrid_merge(v: Views) -> DataFrame:
    """Two ranked lists merged: ids of both first."""
    f = v["v_functions"]
    numbered = lambda d, *o: d.select("id", F.row_number().over(Window.orderBy(*o)).cast("long").alias("pos"))  # noqa: E731  eight rows
    k = numbered(search.search_functions(f, "steel", 8, rank="table"), "file_id", "start_line", "id")
    s = numbered(f.filter("name ilike '%bolt%' or name ilike '%steel%'").orderBy(F.col("complexity").desc(), "id").limit(8), F.col("complexity").desc(), "id")
    return search.hybrid_merge(k, s).select("id", "bucket", "keyword_pos", "vector_pos")


def _sections_sql(words: list[str]) -> str:
    """Sections for words: of the ten best functions, files by path, and the classes and types in those functions' files."""
    section = lambda pos, title, order, limit, source, relevance, rows: f"""SELECT {pos} AS pos, '{title}' AS title, '## {title}' || chr(10) || chr(10) || string_agg(line, '' ORDER BY n) FILTER (n <= {limit}) AS content,
  (SELECT list(s ORDER BY k) FROM (SELECT {source} AS s, min(n) AS k FROM {rows} GROUP BY 1)) AS source_files, {relevance} AS relevance FROM {rows} HAVING count(*) > 0"""  # noqa: E731
    return f"""{duckdb_ctes('v_functions', 'v_classes', 'v_types')},
fn AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id, start_line, id) AS n FROM (SELECT *, {_score(words)} AS score FROM v_functions WHERE {_like(['name', 'full_name', 'doc_comment'], words)}) QUALIFY n <= 10),
places AS (SELECT file_id, min(n) AS file_pos FROM fn GROUP BY file_id),
fs AS (SELECT n, file_id, score, '### ' || full_name || chr(10) || '- **Location:** ' || file_id || ':' || start_line || '-' || end_line || chr(10) || '- **Signature:** `' || signature || '`' || chr(10)
  || CASE WHEN coalesce(doc_comment, '') <> '' THEN '- **Doc:** ' || substring(doc_comment, 1, 200) || chr(10) ELSE '' END || '- **Exported:** ' || CASE WHEN is_exported THEN 'Yes' ELSE 'No' END || chr(10) || '- **Complexity:** ' || complexity || chr(10) || chr(10) AS line FROM fn),
ps AS (SELECT row_number() OVER (ORDER BY path) AS n, path, '- **' || path || '** — ' || language || ', ' || token_count || ' tokens' || CASE WHEN is_test THEN ' (test)' ELSE '' END || chr(10) AS line FROM v_files WHERE {_like(['path'], words)} QUALIFY n <= 10),
cs AS (SELECT row_number() OVER (ORDER BY file_pos, id) AS n, file_id, '### ' || name || chr(10) || CASE WHEN coalesce(extends_id, '') <> '' THEN '- **Extends:** ' || string_split(extends_id, ':')[-1] || chr(10) ELSE '' END
  || CASE WHEN len(methods) > 0 THEN '- **Methods:** ' || array_to_string(list_transform(methods, lambda m: string_split(m, ':')[-1]), ', ') || chr(10) ELSE '' END || chr(10) AS line FROM v_classes JOIN places USING (file_id)),
ts AS (SELECT row_number() OVER (ORDER BY file_pos, id) AS n, file_id, '- **' || name || '** (' || kind || ')' || chr(10) || CASE WHEN len(properties) > 0 THEN '  - Properties: ' || array_to_string(properties, ', ') || chr(10) ELSE '' END AS line FROM v_types JOIN places USING (file_id)),
parts AS ({section(1, 'Relevant Functions', 'n', 8, 'file_id', 'round(sum(score) FILTER (n <= 8) / count(*), 9)', 'fs')}
UNION ALL {section(2, 'Related Files', 'n', 8, 'path', 'CAST(0.5 AS DOUBLE)', 'ps')}
UNION ALL {section(3, 'Related Classes', 'n', 5, 'file_id', 'CAST(0.6 AS DOUBLE)', 'cs')}
UNION ALL {section(4, 'Related Types', 'n', 5, 'file_id', 'CAST(0.4 AS DOUBLE)', 'ts')}),
told AS (SELECT *, CAST(ceil(length(content) / 4.0) AS INTEGER) AS tokens FROM parts),
summed AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY pos) AS BIGINT) AS running FROM told)
SELECT pos, title, content, source_files, relevance, tokens, running, running <= {BUDGET} AS kept FROM summed"""


def _sections(v: Views, query: str) -> DataFrame:
    sections, _ = search.find_context(_tables(v), query, BUDGET)
    return sections.withColumn("relevance", F.round("relevance", 9)).select("pos", "title", "content", "source_files", "relevance", "tokens", "running", "kept")


@query(_sections_sql(WORDS))
def context(v: Views) -> DataFrame:
    """Sections for a query under a token budget."""
    return _sections(v, QUERY)


@query(_sections_sql(keywords_py(expand_query_py(normalize_query_py(FILES_QUERY)))))
def context_of_all_kinds(v: Views) -> DataFrame:
    """Sections of functions, files, classes and types."""
    return _sections(v, FILES_QUERY)


@query(f"""{duckdb_ctes('v_functions', 'v_classes', 'v_types')},
c AS (SELECT file_id, string_agg('- ' || name || CASE WHEN coalesce(extends_id, '') <> '' THEN ' extends ' || string_split(extends_id, ':')[-1] ELSE '' END || chr(10) || CASE WHEN len(methods) > 0 THEN '  - Methods: ' || array_to_string(list_transform(methods, lambda m: string_split(m, ':')[-1]), ', ') || chr(10) ELSE '' END, '' ORDER BY id) AS c FROM v_classes GROUP BY file_id),
f AS (SELECT file_id, string_agg('- ' || full_name || ': ' || signature || chr(10) || CASE WHEN coalesce(doc_comment, '') <> '' THEN '  - ' || string_split(doc_comment, chr(10))[1] || chr(10) ELSE '' END, '' ORDER BY start_line, id) AS f FROM v_functions GROUP BY file_id),
t AS (SELECT file_id, string_agg('- ' || name || ' (' || kind || ')' || chr(10), '' ORDER BY id) AS t FROM v_types GROUP BY file_id)
SELECT path, '## File: ' || path || chr(10) || chr(10) || 'Language: ' || language || chr(10) || 'Token count: ' || token_count || chr(10) || 'Is test: ' || CASE WHEN is_test THEN 'true' ELSE 'false' END || chr(10) || chr(10)
  || coalesce('### Classes' || chr(10) || chr(10) || c || chr(10), '') || coalesce('### Functions' || chr(10) || chr(10) || f || chr(10), '') || coalesce('### Types' || chr(10) || chr(10) || t || chr(10), '') AS content
FROM v_files LEFT JOIN c ON c.file_id = v_files.id LEFT JOIN f ON f.file_id = v_files.id LEFT JOIN t ON t.file_id = v_files.id""")
def file_context(v: Views) -> DataFrame:
    """What is known of each file."""
    return search.file_contexts(v["v_files"], _tables(v)).select("path", "content")


# --- store ------------------------------------------------------------------------------------------------------------


@query(f"{duckdb_ctes('v_functions', 'v_classes', 'v_types')} SELECT 'files' AS entity, count(*) AS n FROM v_files UNION ALL SELECT 'functions', count(*) FROM v_functions UNION ALL SELECT 'classes', count(*) FROM v_classes UNION ALL SELECT 'types', count(*) FROM v_types")
def index_stats(v: Views) -> DataFrame:
    return store.counts(_tables(v))


@query(f"""{duckdb_ctes('v_files')}, old AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE content_hash END AS content_hash FROM v_files WHERE doc_id % 5 <> 0)
SELECT f.path, CASE WHEN old.path IS NULL THEN 'new' WHEN old.content_hash <> f.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM v_files f LEFT JOIN old ON old.path = f.path""")
def incremental_diff(v: Views) -> DataFrame:
    """Files against an older index."""
    files = v["v_files"]
    old = files.filter("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"))
    return store.diff(files.select("path", "content_hash"), old).select("path", "status")


@query("SELECT user_id AS id, event_id AS seq, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(v: Views) -> DataFrame:
    """The last row of each key."""
    rows = v["events"].select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    return store.latest(rows, ["id"], "seq")


@query("SELECT id, CAST(sum(n) AS BIGINT) AS n, max(last) AS last FROM (SELECT user_id AS id, 1 AS n, event_id AS last FROM events WHERE event_id % 10 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 10 = 0) UNION ALL SELECT user_id, 1, max(event_id) FROM events WHERE event_id % 10 = 0 GROUP BY user_id) GROUP BY id")
def upsert_merge(v: Views) -> DataFrame:
    """An old table with changed keys replaced: every tenth event is a change, all others are the old table."""
    e = v["events"].select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"))
    merged = store.merged(e.filter("seq % 10 <> 0"), store.latest(e.filter("seq % 10 = 0"), ["id"], "seq"), ["id"])
    return merged.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


_GONE = "(SELECT id FROM v_files WHERE doc_id % 4 = 0)"


@query(f"{duckdb_ctes('v_functions', 'v_classes', 'v_types')} SELECT 'files' AS entity, count(*) AS n FROM v_files WHERE id NOT IN {_GONE} UNION ALL SELECT 'functions', count(*) FROM v_functions WHERE file_id NOT IN {_GONE} UNION ALL SELECT 'classes', count(*) FROM v_classes WHERE file_id NOT IN {_GONE} UNION ALL SELECT 'types', count(*) FROM v_types WHERE file_id NOT IN {_GONE}")
def cascade_delete(v: Views) -> DataFrame:
    """What is left when every fourth file goes."""
    gone = v["v_files"].filter("doc_id % 4 = 0").select("id")
    return store.counts(store.without_files(_tables(v), gone))


@query(f"{duckdb_ctes('v_feedback')} SELECT context_id, count(*) AS n, avg(rating) AS rating, count(*) FILTER (rejected) AS rejected, max(doc_id) AS last FROM v_feedback GROUP BY context_id")
def feedback_by_context(v: Views) -> DataFrame:
    """Feedback on each context: how often, how good, how often something was rejected, and the last."""
    rejected = F.when(F.col("rejected"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = v["v_feedback"].select("id", "context_id", "rating", rejected.alias("rejected_items"), F.timestamp_seconds("doc_id").alias("created_at"))
    return store.feedback_summary(rows).withColumn("last", F.unix_seconds("last"))


@query(f"{duckdb_ctes('v_changes')} SELECT path, op, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM v_changes WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') WHERE r = 1")
def what_changed(v: Views) -> DataFrame:
    """The last change of each path in a span of time."""
    span = v["v_changes"].filter("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-20'")
    return store.latest(span.select("path", "op", "ts", "seq"), ["path"], "seq")


# --- conventions ------------------------------------------------------------------------------------------------------

_REPORT = "category, name, confidence, examples, description"


def _rules(first: str, rows: list[tuple[str, str, str, str, str]], counts: str, tail: str = "") -> str:
    """SQL of fired rules: (category, name, condition, confidence, description, examples) over one row of counts."""
    return f"{first}, n AS ({counts}) " + " UNION ALL ".join(f"SELECT '{c}' AS category, '{n}' AS name, CAST({conf} AS DOUBLE) AS confidence, {ex} AS examples, {d} AS description FROM n WHERE {cond}" for c, n, cond, conf, d, ex in rows) + tail


_CAMEL, _PASCAL, _SNAKE = "'^[a-z][a-zA-Z0-9]*$'", "'^[A-Z][a-zA-Z0-9]*$'", "'^[a-z][a-z0-9]*(_[a-z0-9]+)*$'"
_NO_STRINGS = "CAST([] AS VARCHAR[])"


def _top(column: str, condition: str, order: str, n: int = 5) -> str:
    return f"coalesce(list({column} ORDER BY {order}) FILTER ({condition}), {_NO_STRINGS})[1:{n}]"


def _r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE"


_NAMING_COUNTS = "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({c}) AS {k}, {_top('full_name', c, 'file_id, start_line, id')} AS x_{k}" for k, c in {
    "camel": f"regexp_matches(name, {_CAMEL})", "pascal": f"regexp_matches(name, {_PASCAL})", "snake": f"regexp_matches(name, {_SNAKE})", "exported": "is_exported",
    "ecamel": f"is_exported AND regexp_matches(name, {_CAMEL})", "epascal": f"is_exported AND regexp_matches(name, {_PASCAL})"}.items()) + " FROM v_functions"
_NAMING = [
    ("naming", "camelCase function names", "camel / total > 0.3", _r2("camel / total"), "camel || ' of ' || total || ' functions use camelCase naming'", "x_camel"),
    ("naming", "PascalCase function names", "pascal / total > 0.2", _r2("pascal / total"), "pascal || ' functions use PascalCase (likely React components or classes)'", "x_pascal"),
    ("naming", "snake_case function names", "snake / total > 0.3", _r2("snake / total"), "snake || ' functions use snake_case naming'", "x_snake"),
    ("naming", "Exported functions use camelCase", "ecamel / greatest(exported, 1) > 0.5", _r2("ecamel / greatest(exported, 1)"), "ecamel || ' of ' || exported || ' exported functions use camelCase'", "x_ecamel"),
    ("naming", "Exported functions use PascalCase", "epascal / greatest(exported, 1) > 0.5", _r2("epascal / greatest(exported, 1)"), "epascal || ' of ' || exported || ' exported functions use PascalCase'", "x_epascal"),
]
_FILE_COUNTS = "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({c}) AS {k}, {_top('path', c, 'path')} AS x_{k}" for k, c in {
    "barrel": "path LIKE '%/index.ts' OR path LIKE '%/index.tsx'", "src": "path LIKE 'src/%'", "packages": "path LIKE 'packages/%'", "tests_dir": "contains(path, '__tests__/')", "test": "is_test",
    "dot_test": "is_test AND (path LIKE '%.test.ts' OR path LIKE '%.test.tsx')", "dot_spec": "is_test AND (path LIKE '%.spec.ts' OR path LIKE '%.spec.tsx')", "colocated": "is_test AND NOT contains(path, '__tests__/')",
    "docs": "path LIKE 'docs/%'", "scripts": "path LIKE 'scripts/%'", "pnpm": "path = 'pnpm-lock.yaml'", "turbo": "path = 'turbo.json'"}.items()) + ", list(path ORDER BY path) FILTER (path LIKE 'src/%') AS all_src FROM v_files"
_STRUCTURE = [
    ("file-structure", "Barrel export files (index.ts)", "barrel > 2", "least(barrel / 10, 1)", "barrel || ' barrel files found. Common pattern for re-exporting modules.'", "x_barrel"),
    ("file-structure", "Source code in src/ directory", "src / greatest(total, 1) > 0.5", _r2("src / total"), "src || ' of ' || total || ' files are under src/'", "[all_src[1], all_src[CAST(src // 2 AS INTEGER) + 1]]"),
    ("file-structure", "Monorepo package structure", "packages > 0", "least(packages / 20, 1)", "packages || ' files in a monorepo packages/ structure'", "x_packages"),
    ("file-structure", "Tests in __tests__ directories", "tests_dir > 0", "least(tests_dir / 5, 1)", "tests_dir || ' test files in __tests__/ directories'", "x_tests_dir"),
]
_TESTING = [
    ("testing", "No test files detected", "test = 0", "1", "'No test files found in the codebase.'", _NO_STRINGS),
    ("testing", "Test files use .test.ts suffix", "test > 0 AND dot_test / test > 0.5", _r2("dot_test / test"), "dot_test || ' of ' || test || ' test files use .test.ts naming (Vitest/Jest convention)'", "x_dot_test"),
    ("testing", "Test files use .spec.ts suffix", "test > 0 AND dot_spec / test > 0.5", _r2("dot_spec / test"), "dot_spec || ' of ' || test || ' test files use .spec.ts naming'", "x_dot_spec"),
    ("testing", "Test file ratio", "test > 0", "1", "CAST(floor(test / total * 100 + 0.5::DOUBLE) AS INTEGER) || '% of files are test files (' || test || ' of ' || total || ')'", _NO_STRINGS),
    ("testing", "Co-located test files", "test > 0 AND colocated / test > 0.5", _r2("colocated / test"), "colocated || ' test files are co-located with source files'", "x_colocated"),
]
_BARRELS = ("exports", "Barrel export pattern", "barrel > 0", "least(barrel / 5, 1)", "barrel || ' barrel index files found'", "x_barrel")
_EXPORTED = ("exports", "Export visibility", "exported > 0", "1", "CAST(floor(exported / total * 100 + 0.5::DOUBLE) AS INTEGER) || '% of functions are exported'", "x_exported")
_DIRECTORIES = [
    ("directory", "Documentation in docs/", "docs > 0", "0.9", "'Project has a dedicated docs/ directory for documentation'", "x_docs[1:3]"),
    ("directory", "Build/tool scripts in scripts/", "scripts > 0", "0.9", "'Project has a scripts/ directory for build and tool scripts'", "x_scripts[1:3]"),
    ("directory", "pnpm package manager", "pnpm > 0", "1", "'Project uses pnpm as the package manager'", "x_pnpm"),
    ("directory", "Turborepo monorepo", "turbo > 0", "1", "'Project uses Turborepo for monorepo orchestration'", "x_turbo"),
]


def _report(df: DataFrame) -> DataFrame:
    return df.select(*_REPORT.split(", "))


@query(_rules(duckdb_ctes("v_functions"), _NAMING, _NAMING_COUNTS))
def naming_conventions(v: Views) -> DataFrame:
    return _report(conventions.naming(v["v_functions"]))


@query(_rules(duckdb_ctes("v_files"), _STRUCTURE, _FILE_COUNTS))
def file_structure_conventions(v: Views) -> DataFrame:
    return _report(conventions.file_structure(v["v_files"]))


@query(_rules(duckdb_ctes("v_files"), _TESTING, _FILE_COUNTS))
def testing_conventions(v: Views) -> DataFrame:
    return _report(conventions.testing(v["v_files"]))


@query(f"{duckdb_ctes('v_functions')}, n AS (SELECT * FROM ({_NAMING_COUNTS}) AS a, (SELECT barrel, x_barrel FROM ({_FILE_COUNTS}) AS f) AS b) " + " UNION ALL ".join(f"SELECT '{c}' AS category, '{n}' AS name, CAST({conf} AS DOUBLE) AS confidence, {ex} AS examples, {d} AS description FROM n WHERE {cond}" for c, n, cond, conf, d, ex in (_EXPORTED, _BARRELS)))
def export_conventions(v: Views) -> DataFrame:
    return _report(conventions.exports(v["v_functions"], v["v_files"]))


@query(f"{duckdb_ctes('v_files')} SELECT string_split(path, '/')[1] AS directory, count(*) AS files FROM v_files GROUP BY 1")
def directory_conventions(v: Views) -> DataFrame:
    return conventions.top_directories(v["v_files"])


def _of_settings(sql: str) -> str:
    return sql.replace("v_files", "v_settings")


@query(_of_settings(_rules(duckdb_ctes("v_settings"), [*_STRUCTURE, *_TESTING, *_DIRECTORIES], _FILE_COUNTS)))
def directory_rules(v: Views) -> DataFrame:
    """Rules on paths, over files that have documentation, scripts, lock files and test folders."""
    files = v["v_settings"]
    return _report(conventions.file_structure(files).union(conventions.testing(files)).union(conventions.directories(files)))


@query(f"{duckdb_ctes('v_functions')}, f AS ({_NAMING_COUNTS}), g AS ({_FILE_COUNTS}), r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, CAST({conf} AS DOUBLE) AS confidence, {ex} AS examples FROM {t} WHERE {cond}" for t, rules in (("f", [*_NAMING, _EXPORTED]), ("g", [*_STRUCTURE, *_TESTING, _BARRELS, *_DIRECTORIES])) for c, _, cond, conf, _, ex in rules
) + ") SELECT category, CAST(sum(len(examples)) AS BIGINT) AS examples, count(*) AS conventions, count(*) FILTER (confidence > 0.7) AS high_confidence FROM r GROUP BY category")
def convention_report(v: Views) -> DataFrame:
    return conventions.file_counts(conventions.detect(v["v_functions"], v["v_files"]))


# --- architecture -----------------------------------------------------------------------------------------------------

_MEMBERS = f"""{duckdb_ctes('v_functions')},
members AS (SELECT unnest(CASE WHEN p[1] = 'packages' AND len(p) >= 3 THEN [p[1] || '/' || p[2], p[1] || '/' || p[2] || '/' || p[3]] ELSE [p[1] || '/' || p[2]] END) AS root_path, id AS file_id, path FROM (SELECT *, string_split(path, '/') AS p FROM v_files) WHERE len(p) > 1),
large AS (SELECT root_path, count(*) AS n_files FROM members GROUP BY root_path HAVING count(*) >= 2),
exports AS (SELECT DISTINCT file_id, full_name FROM v_functions WHERE is_exported)"""


@query(f"{_MEMBERS} SELECT root_path, n_files, array_to_string(list_transform(regexp_extract_all(regexp_replace(string_split(root_path, '/')[-1], '[-_]', ' ', 'g'), '[0-9A-Za-z_]+|[^0-9A-Za-z_]+'), lambda x: upper(x[1]) || x[2:]), '') AS name FROM large")
def modules(v: Views) -> DataFrame:
    return architecture.large_modules(architecture.module_members(v["v_files"])).withColumn("name", module_name(F.col("root_path")))


@query(f"""{_MEMBERS}, sets AS (SELECT m.root_path, m.file_id, coalesce(list(e.full_name) FILTER (e.full_name IS NOT NULL), {_NO_STRINGS}) AS s FROM members m LEFT JOIN exports e USING (file_id) GROUP BY ALL),
pairs AS (SELECT a.root_path, len(list_intersect(a.s, b.s)) AS i, len(list_distinct(list_concat(a.s, b.s))) AS u FROM sets a JOIN sets b ON a.root_path = b.root_path AND a.file_id < b.file_id)
SELECT root_path, round(avg(CASE WHEN u > 0 THEN i / u ELSE 0 END), 9) AS cohesion FROM pairs GROUP BY root_path""")
def module_cohesion(v: Views) -> DataFrame:
    out = architecture.cohesion(architecture.module_members(v["v_files"]), architecture.file_exports(v["v_functions"]))
    return out.select("root_path", F.round("cohesion", 9).alias("cohesion"))


@query(f"""{_MEMBERS}, names AS (SELECT DISTINCT full_name FROM exports), texts AS (SELECT DISTINCT lower(name) AS a, lower(full_name) AS b, lower(doc_comment) AS c FROM v_functions),
said AS (SELECT full_name, a, b, c FROM names JOIN texts ON a LIKE '%' || lower(full_name) || '%' OR b LIKE '%' || lower(full_name) || '%' OR c LIKE '%' || lower(full_name) || '%'),
hits AS (SELECT DISTINCT s.full_name, f.file_id FROM said s JOIN v_functions f ON lower(f.name) = s.a AND lower(f.full_name) = s.b AND lower(f.doc_comment) = s.c),
every AS (SELECT full_name, count(*) AS n FROM hits GROUP BY full_name),
within AS (SELECT m.root_path, h.full_name, count(*) AS n FROM hits h JOIN members m USING (file_id) GROUP BY ALL),
owned AS (SELECT m.root_path, e.full_name, every.n > coalesce(within.n, 0) AS outside FROM members m JOIN exports e USING (file_id) JOIN every USING (full_name) LEFT JOIN within ON within.root_path = m.root_path AND within.full_name = e.full_name)
SELECT l.root_path, coalesce(count(*) FILTER (outside) / nullif(count(outside), 0), 0) AS coupling FROM large l LEFT JOIN owned o USING (root_path) GROUP BY l.root_path""")
def module_coupling(v: Views) -> DataFrame:
    return architecture.coupling(architecture.module_members(v["v_files"]), architecture.file_exports(v["v_functions"]), v["v_functions"])


@query(f"{_MEMBERS} SELECT m.root_path, list(DISTINCT e.full_name ORDER BY e.full_name) AS exports, count(DISTINCT e.full_name) AS n FROM members m JOIN large USING (root_path) JOIN exports e USING (file_id) GROUP BY m.root_path")
def module_exports(v: Views) -> DataFrame:
    """Distinct exported names of each module."""
    members = architecture.module_members(v["v_files"])
    found = architecture.module_exports(members, architecture.file_exports(v["v_functions"]))
    return found.join(architecture.large_modules(members), "root_path", "left_semi").withColumn("n", F.size("exports").cast("long"))


_IMPORTS = "rel AS (SELECT 'rel:' || a.doc_id AS id, a.id AS source_id, b.id AS target_id FROM v_files a JOIN (SELECT doc_id // 10 AS g, min_by(id, doc_id) AS id FROM v_files GROUP BY 1) b ON b.g = a.doc_id // 10 WHERE a.id <> b.id)"


def _relationships(v: Views) -> DataFrame:
    """Each file imports the first of its ten."""
    f = v["v_files"].withColumn("g", F.expr("doc_id div 10"))
    first = f.groupBy("g").agg(F.min_by("id", "doc_id").alias("target_id"))
    rows = f.join(first, "g").filter("id <> target_id")
    return rows.select(F.concat(F.lit("rel:"), F.col("doc_id").cast("string")).alias("id"), F.col("id").alias("source_id"), "target_id", F.lit("imports").alias("relation_type"), F.create_map().cast("map<string,string>").alias("metadata"))


@query(f"{_MEMBERS}, {_IMPORTS}, used AS (SELECT DISTINCT root_path, target_id FROM members JOIN rel ON source_id = file_id) SELECT root_path, list(target_id ORDER BY target_id) AS imports FROM used WHERE (root_path, target_id) NOT IN (SELECT (root_path, file_id) FROM members) GROUP BY root_path")
def module_imports(v: Views) -> DataFrame:
    """Distinct files outside that each module imports."""
    return architecture.module_imports(architecture.module_members(v["v_files"]), _relationships(v))


@query(f"{_MEMBERS} SELECT a.root_path, b.root_path AS sub_path FROM (SELECT DISTINCT root_path FROM members) a JOIN large b ON starts_with(b.root_path, a.root_path || '/')")
def submodules(v: Views) -> DataFrame:
    return architecture.submodules(architecture.module_members(v["v_files"]))


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_LAYERS = " UNION ALL ".join(
    f"SELECT '{name}' AS name, {_r2('c')} AS confidence, 'Detected ' || m || ' modules and ' || f || ' files matching {name.lower()} patterns.' AS description, e AS evidence, r AS related_files FROM (SELECT *, least((m + f / 10) / 5, 1) AS c FROM (SELECT count(*) FILTER ({_any('root_path', words)}) AS m, {_top('root_path', _any('root_path', words), 'root_path', 3)} AS e FROM large), (SELECT count(*) FILTER ({_any('path', words)}) AS f, {_top('path', _any('path', words), 'path', 10)} AS r FROM v_files)) WHERE c > 0.2" for name, words in LAYERS.items())


@query(f"{_MEMBERS} {_LAYERS}")
def layers(v: Views) -> DataFrame:
    return architecture.layers(v["v_files"]).select("name", "confidence", "description", "evidence", "related_files")


@query(f"{duckdb_ctes('v_files')} " + " UNION ALL ".join(f"SELECT '{name}' AS name, CAST(least(n / 3, 0.9) AS DOUBLE) AS confidence, n || ' files suggest {usage}.' AS description, r AS related_files FROM (SELECT count(*) AS n, {_top('path', _any('path', words), 'path', 10)} AS r FROM v_files WHERE {_any('path', words)}) WHERE n > 0" for _, name, usage, words in PATTERNS))
def patterns(v: Views) -> DataFrame:
    return architecture.patterns(v["v_files"]).select("name", "confidence", "description", "related_files")


_DOMAINS = " UNION ALL ".join(f"SELECT '{k.capitalize()} Domain' AS name, CAST(least(n / 3, 0.95) AS DOUBLE) AS confidence, n || ' modules related to {k.capitalize()} functionality.' AS description, e AS evidence FROM (SELECT count(*) AS n, list(root_path ORDER BY root_path) AS e FROM large WHERE contains(lower(root_path), '{k}')) WHERE n > 0" for k in DOMAINS)


@query(f"{_MEMBERS} {_DOMAINS}")
def domains(v: Views) -> DataFrame:
    return architecture.domains(v["v_files"]).select("name", "confidence", "description", "evidence")


_OTHER_MEMBERS = f"""{duckdb_ctes('v_settings')},
members AS (SELECT unnest(CASE WHEN p[1] = 'packages' AND len(p) >= 3 THEN [p[1] || '/' || p[2], p[1] || '/' || p[2] || '/' || p[3]] ELSE [p[1] || '/' || p[2]] END) AS root_path, id AS file_id, path FROM (SELECT *, string_split(path, '/') AS p FROM v_settings) WHERE len(p) > 1),
large AS (SELECT root_path, count(*) AS n_files FROM members GROUP BY root_path HAVING count(*) >= 2)"""


@query(f"{_OTHER_MEMBERS} {_of_settings(_LAYERS)}")
def layers_of_all_kinds(v: Views) -> DataFrame:
    """Layers of files that have folders of every layer."""
    return architecture.layers(v["v_settings"]).select("name", "confidence", "description", "evidence", "related_files")


@query(f"{_OTHER_MEMBERS} {_DOMAINS}")
def domains_of_all_kinds(v: Views) -> DataFrame:
    """Domains of files that have modules of every domain."""
    return architecture.domains(v["v_settings"]).select("name", "confidence", "description", "evidence")


# --- graph ------------------------------------------------------------------------------------------------------------


def _graph(v: Views, properties: bool = True) -> tuple[DataFrame, DataFrame]:
    tables = _tables(v)
    return graph.nodes(tables, properties=properties), graph.edges(tables, graph.node_ids(tables))


_GRAPH = f"""{duckdb_ctes('v_functions', 'v_classes', 'v_types')},
nodes AS (SELECT id, 'file' AS type, string_split(path, '/')[-1] AS label FROM v_files UNION ALL SELECT id, 'function', full_name FROM v_functions UNION ALL SELECT id, 'class', name FROM v_classes UNION ALL SELECT id, 'type', name FROM v_types),
edges AS (
  SELECT 'edge:' || file_id || ':has_function:' || id AS id, file_id AS source, id AS target, 'has_function' AS type, 'contains' AS label FROM v_functions
  UNION ALL SELECT 'edge:' || file_id || ':has_class:' || id, file_id, id, 'has_class', 'contains' FROM v_classes
  UNION ALL SELECT 'edge:' || c.id || ':has_method:' || m, c.id, m, 'has_method', 'method' FROM (SELECT id, unnest(methods) AS m FROM v_classes) c WHERE m IN (SELECT id FROM nodes)
  UNION ALL SELECT 'edge:' || id || ':extends:' || extends_id, id, extends_id, 'extends', 'extends' FROM v_classes WHERE extends_id IN (SELECT id FROM nodes)
  UNION ALL SELECT 'edge:' || file_id || ':has_type:' || id, file_id, id, 'has_type', 'contains' FROM v_types)"""


@query(f"{_GRAPH} SELECT id, type, label FROM nodes")
def graph_nodes(v: Views) -> DataFrame:
    return _graph(v, properties=False)[0].select("id", "type", "label")


@query(f"{_GRAPH} SELECT id, source, target, type, label FROM edges")
def graph_edges(v: Views) -> DataFrame:
    return _graph(v, properties=False)[1]


@query(f"{_GRAPH} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'node', NULL, count(*) FROM nodes UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'edge', NULL, count(*) FROM edges")
def graph_stats(v: Views) -> DataFrame:
    return graph.stats(*_graph(v, properties=False))


@query(f"{_GRAPH} SELECT floor((SELECT count(*) FROM edges) * 2 / (SELECT count(*) FROM nodes) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS average_degree")
def average_degree(v: Views) -> DataFrame:
    return graph.average_degree(graph.stats(*_graph(v, properties=False)))


_BOTH = f"{duckdb_ctes('v_edges')}, both_ways AS (SELECT source AS a, target AS b, id FROM v_edges UNION ALL SELECT target, source, id FROM v_edges)"


def _stored(v: Views, **tables: DataFrame) -> store.Store:
    """A store of its own in the shared folder."""
    s = store.Store(v.spark, new_path(v.spark, "store"), buckets=8)
    s.write(tables)
    return s


@query(SQL["keyword_search"])
def store_search(v: Views) -> DataFrame:
    """Keyword search over a store on disk, by its index of grams."""
    found = _stored(v, functions=v["v_functions"]).search_functions(TEXT, 10)
    return found.select("id", "name", "file_id", F.round("score", 9).alias("score"))


@query(SQL["cosine_topk"])
def store_nearest(v: Views) -> DataFrame:
    """The vectors nearest to the first one, by a store's inverted lists in exact mode."""
    s = _stored(v, embeddings=v["v_vectors"])
    s.build_vector_index()
    found = s.vector_top_k(list(v["v_vectors"].filter("vec_id = 0").first().embedding), 20, probed=None)
    return found.select("entity_id", F.round("score", 6).alias("score"))


_AROUND = f"{duckdb_ctes('v_files')}, {_IMPORTS}, both_ways AS (SELECT source_id AS a, target_id AS b, id FROM rel UNION ALL SELECT target_id, source_id, id FROM rel), start AS (SELECT id AS s FROM v_files WHERE doc_id = 11)"


@query(f"{_AROUND}, one AS (SELECT b AS id, min(id) AS edge_id FROM both_ways, start WHERE a = s GROUP BY b), two AS (SELECT b AS id, min(x.id) AS edge_id FROM both_ways x JOIN one ON one.id = x.a, start WHERE b <> s AND b NOT IN (SELECT id FROM one) GROUP BY b) SELECT id, 1 AS distance, edge_id FROM one UNION ALL SELECT id, 2, edge_id FROM two")
def store_neighbours(v: Views) -> DataFrame:
    """Files within two imports of one, from a store's edges by both ends."""
    start = v["v_files"].filter("doc_id = 11").first().id
    return _stored(v, relationships=_relationships(v)).neighbours(start, 2)


@query(f"{duckdb_ctes('v_functions')}, f AS (SELECT id, file_id, CASE WHEN complexity < 10 THEN name || '2' ELSE name END AS name FROM v_functions) SELECT substr(md5(id), 1, 12) AS short_id, id, name FROM f WHERE file_id NOT IN (SELECT id FROM v_files WHERE doc_id % 10 = 3)")
def store_changes(v: Views) -> DataFrame:
    """A store on disk after an upsert of some functions and the deletion of some files: what is left, with short ids."""
    s = _stored(v, files=v["v_files"], functions=v["v_functions"])
    s.upsert("functions", v["v_functions"].filter("complexity < 10").withColumn("name", F.concat("name", F.lit("2"))))
    s.delete_files(v["v_files"].filter("doc_id % 10 = 3").select("id"))
    return s.table("functions").select(short_id(F.col("id")).alias("short_id"), "id", "name")


@query(f"{_BOTH}, one AS (SELECT b AS id, min(id) AS edge_id FROM both_ways WHERE a = 'n3' GROUP BY b), two AS (SELECT b AS id, min(x.id) AS edge_id FROM both_ways x JOIN one ON one.id = x.a WHERE b <> 'n3' AND b NOT IN (SELECT id FROM one) GROUP BY b) SELECT id, 1 AS distance, edge_id FROM one UNION ALL SELECT id, 2, edge_id FROM two")
def neighbors_d2(v: Views) -> DataFrame:
    """Nodes within two edges of a nation."""
    return graph.neighbours(v["v_edges"], "n3", 2)


@query(f"""{_BOTH}, pick AS (SELECT min(c_custkey) AS c, max(s_suppkey) AS s FROM customer, supplier, nation a, nation b WHERE c_nationkey = a.n_nationkey AND s_nationkey = b.n_nationkey AND a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND a.n_regionkey = 1),
walk(id, d) AS (SELECT 'c' || c, 0 FROM pick WHERE c IS NOT NULL UNION SELECT b, d + 1 FROM walk JOIN both_ways ON a = walk.id WHERE d < 8)
SELECT CAST(min(d) AS INTEGER) AS length, 'c' || c AS source, 's' || s AS target FROM pick JOIN walk ON walk.id = 's' || s GROUP BY c, s""")
def shortest_path(v: Views) -> DataFrame:
    """Length of the path between a customer and a supplier of two nations of one region (customer, nation, region, nation, supplier)."""
    n = v["nation"].select("n_nationkey", "n_regionkey")
    pairs = n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("a"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey").filter("a <> b")
    c, s = v["customer"].select("c_custkey", F.col("c_nationkey").alias("a")), v["supplier"].select("s_suppkey", F.col("s_nationkey").alias("b"))
    ends = pairs.join(c.groupBy("a").agg(F.min("c_custkey").alias("c")), "a").join(s.groupBy("b").agg(F.max("s_suppkey").alias("s")), "b").agg(F.min("c").alias("c"), F.max("s").alias("s")).first()
    rows = []
    if ends.c is not None:
        path = graph.shortest_path(v["v_edges"], f"c{ends.c}", f"s{ends.s}")
        rows = [(None if path is None else len(path), f"c{ends.c}", f"s{ends.s}")]
    return v.spark.createDataFrame(rows, "length int, source string, target string")


@query(f"{duckdb_ctes('v_nodes')}, of AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS k FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT id, min(id) OVER (PARTITION BY k) AS component FROM of")
def components(v: Views) -> DataFrame:
    """Connected components of the tree of regions."""
    return graph.components(v["v_nodes"].select("id"), v["v_edges"])


@query(f"{_GRAPH} SELECT '  \"' || id || '\" [label=\"' || label || '\", fillcolor=\"' || CASE type WHEN 'file' THEN 'lightblue' WHEN 'function' THEN 'lightgreen' WHEN 'class' THEN 'lightsalmon' WHEN 'type' THEN 'lightyellow' ELSE 'lightgray' END || '\"];' AS line FROM nodes UNION ALL SELECT '  \"' || source || '\" -> \"' || target || '\" [label=\"' || type || '\"];' FROM edges")
def dot_export(v: Views) -> DataFrame:
    return graph.dot_lines(*_graph(v, properties=False)).select("line")


@query(f"{_GRAPH} SELECT e.id, e.type FROM edges e WHERE e.source IN (SELECT id FROM nodes WHERE type IN ('file', 'class')) AND e.target IN (SELECT id FROM nodes WHERE type IN ('file', 'class'))")
def type_subgraph(v: Views) -> DataFrame:
    """Edges between files and classes."""
    return graph.of_types(*_graph(v, properties=False), ["file", "class"])[1].select("id", "type")


@query(f"""{_GRAPH}, k AS (SELECT type, row_number() OVER (ORDER BY CASE type WHEN 'file' THEN 0 WHEN 'function' THEN 1 WHEN 'class' THEN 2 ELSE 3 END) - 1 AS k FROM nodes GROUP BY type),
p AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM nodes)
SELECT id, type, round((0.3::DOUBLE + 0.25::DOUBLE * k) * cos(2 * pi() * i / n), 6) + 0 AS x, round((0.3::DOUBLE + 0.25::DOUBLE * k) * sin(2 * pi() * i / n), 6) + 0 AS y FROM p JOIN k USING (type)""")
def radial_layout(v: Views) -> DataFrame:
    """Places of the graph's nodes on rings."""
    out = graph.radial_layout(_graph(v, properties=False)[0])
    return out.select("id", "type", (F.round("x", 6) + 0).alias("x"), (F.round("y", 6) + 0).alias("y"))


@query(f"{_GRAPH} SELECT id, type FROM edges WHERE source = 'class:1' OR target = 'class:1'")
def edge_lookup(v: Views) -> DataFrame:
    """Edges of one entity."""
    edges = _graph(v, properties=False)[1].select("id", F.col("source").alias("source_id"), F.col("target").alias("target_id"), "type")
    return store.relationships_of(edges, "class:1").select("id", "type")


@query(f"{_GRAPH}, {_IMPORTS} SELECT id, source_id AS source, target_id AS target, 'imports' AS label FROM rel")
def graph_imports(v: Views) -> DataFrame:
    """Edges of the graph that come from relationships."""
    tables = _tables(v) | {"relationships": _relationships(v)}
    return graph.edges(tables, graph.nodes(tables)).filter("type = 'imports'").select("id", "source", "target", "label")


#: Trees of files that import one another, one for each ten files, with what they hold.
_TREES = f"""{duckdb_ctes('v_functions', 'v_types')}, kids AS (SELECT file_id, count(*) AS k FROM (SELECT file_id FROM v_functions UNION ALL SELECT file_id FROM v_types) GROUP BY file_id),
f AS (SELECT id, doc_id // 10 AS g, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS dir FROM v_files),
c AS (SELECT min(id) AS component, CAST(count(*) + sum(coalesce(k, 0)) AS BIGINT) AS size, min(dir) AS lo, max(dir) AS hi FROM f LEFT JOIN kids ON file_id = id GROUP BY g),
p AS (SELECT *, len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])) AS n FROM c WHERE size >= 3)"""


@query(f"""{_TREES}
SELECT component, CASE WHEN n > 0 THEN array_to_string(lo[1:n], '/') ELSE 'Cluster-' || size || '-nodes' END AS name, size, size - 1 AS edges, {_r2('(size - 1) / (size * (size - 1) / 2)')} AS density FROM p""")
def clusters(v: Views) -> DataFrame:
    """Clusters of the files that import one another, with their functions and types: trees, one for each ten files."""
    tables = _tables(v) | {"classes": v["v_classes"].filter("false"), "relationships": _relationships(v)}
    n = graph.nodes(tables)
    return graph.clusters(n, graph.edges(tables, n))


@query(f"""{_TREES}
SELECT 'cluster-' || (row_number() OVER (ORDER BY size DESC, component) - 1) AS key, row_number() OVER (ORDER BY size DESC, component) - 1 AS number, component, size FROM p""")
def cluster_numbers(v: Views) -> DataFrame:
    """The same clusters, numbered from the largest."""
    tables = _tables(v) | {"classes": v["v_classes"].filter("false"), "relationships": _relationships(v)}
    n = graph.nodes(tables)
    return graph.numbered_clusters(graph.clusters(n, graph.edges(tables, n))).select("key", F.col("number").cast("long").alias("number"), "component", "size")


# --- import resolution and paths --------------------------------------------------------------------------------------


@query(f"""{duckdb_ctes('v_files')}, spec AS (SELECT path AS from_path, doc_id, CASE doc_id % 5 WHEN 1 THEN '../' ELSE './' END || CASE doc_id % 3 WHEN 0 THEN 'doc' || (doc_id + 60) WHEN 1 THEN '../' || language || '/doc' || (doc_id + 60) ELSE 'doc' || (doc_id + 60) || '.test' END AS spec, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS dir FROM v_files),
base AS (SELECT *, array_to_string(dir[1:len(dir) - (length(spec) - length(replace(spec, '../', ''))) // 3], '/') || '/' || regexp_replace(spec, '^(\\.{{1,2}}/)+', '') AS base FROM spec),
cand AS (SELECT from_path, spec, base || e.ext AS path, e.i FROM base, (VALUES ('.ts', 0), ('.tsx', 1), ('.js', 2), ('.jsx', 3), ('.mjs', 4), ('.cjs', 5), ('/index.ts', 6), ('/index.tsx', 7), ('/index.js', 8), ('/index.jsx', 9), ('/index.mjs', 10), ('/index.cjs', 11)) AS e(ext, i))
SELECT from_path, spec, arg_min(cand.path, i) AS to_path FROM cand JOIN v_files f ON f.path = cand.path GROUP BY from_path, spec""")
def import_resolution(v: Views) -> DataFrame:
    """Relative import specifiers of all files, index files too, resolved against the files."""
    n = (F.col("doc_id") + 60).cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc"), n)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("../"), "language", F.lit("/doc"), n)).otherwise(F.concat(F.lit("doc"), n, F.lit(".test")))
    spec = F.concat(F.when(F.col("doc_id") % 5 == 1, "../").otherwise("./"), name)
    return importing.resolve(v["v_files"].select(F.col("path").alias("from_path"), spec.alias("spec")), v["v_files"])


@query(r"""SELECT page_id, path, regexp_matches(path, '^(?:[^/]*/)*en(?:/.*)?$') OR regexp_matches(path, '^fr/[0-9][^/]*$') OR regexp_matches(path, '^de/.*$') AS ignored
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS path FROM pages)""")
def glob_ignore(v: Views) -> DataFrame:
    """Paths that ignore patterns match."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "")
    rows = v["pages"].select("page_id", path.alias("path"))
    return rows.withColumn("ignored", ignored(F.col("path"), ["en", "fr/*", "de/**"]))


#: A source in one of four languages for each part; the number of its branches varies.
_SOURCES = """SELECT 'src/part' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.rs' END AS path, CASE p_partkey % 4
  WHEN 0 THEN 'export async function ' || n || '(x: number): Promise<number> {{\\n' || repeat('  if (x) {{ x = 1; }}\\n', m) || '  return x;\\n}}\\n'
  WHEN 1 THEN 'def _' || n || '(x):\\n' || repeat('    if x: x = 1\\n', m) || '    return x\\n'
  WHEN 2 THEN 'package main\\n\\nfunc ' || n || '(x int) int {{\\n' || repeat('\\tif x > 0 {{ x = 1 }}\\n', m) || '\\treturn x\\n}}\\n'
  ELSE 'pub fn ' || n || '(x: i32) -> i32 {{\\n' || repeat('    if x > 0 {{ return 1; }}\\n', m) || '    x\\n}}\\n' END AS content
FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n, p_size % 7 AS m FROM {part})"""


@query("""SELECT 'src/part' || p_partkey || ['.ts', '.py', '.go', '.rs'][l + 1] AS file_id, CASE l WHEN 1 THEN '_' ELSE '' END || replace(p_name, ' ', '_') AS name, CAST(1 + p_size % 7 AS INTEGER) AS complexity,
  CASE l WHEN 2 THEN 3 ELSE 1 END AS start_line, CAST(p_size % 7 + [3, 2, 5, 3][l + 1] AS INTEGER) AS end_line, l IN (0, 3) AS is_exported, l = 0 AS is_async FROM (SELECT *, p_partkey % 4 AS l FROM part)""")
def extract_entities(v: Views) -> DataFrame:
    """Functions of a source for each part."""
    from cartulary.operators.parsing import parse_sources

    parsed = parse_sources(v.spark.sql(_SOURCES, part=v["part"]))
    return parsed.select(F.explode("functions").alias("f")).select(*(f"f.{c}" for c in ("file_id", "name", "complexity", "start_line", "end_line", "is_exported", "is_async")))
