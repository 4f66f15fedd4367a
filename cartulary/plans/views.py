"""Entity tables made from ordinary business tables, in SQL that Spark and DuckDB both run.

They let every operator be run and checked on tables that hold no source code. `{...}` are input tables; the few functions whose
names differ are filled in by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.functions.constants import DOMAINS, LAYERS

_DIALECT = {
    "spark": {"sha256": "sha2({0}, 256)", "sorted_set": "array_sort(collect_set({0}))", "array": "array({0})", "strings": "cast(array() AS array<string>)", "string": "STRING"},
    "duckdb": {"sha256": "sha256({0})", "sorted_set": "list_sort(list(DISTINCT {0}))", "array": "[{0}]", "strings": "CAST([] AS VARCHAR[])", "string": "VARCHAR"},
}

FILES = """
SELECT path AS id, path, lang AS language, <<sha256:text>> AS content_hash, CAST(ceil(n_chars / 4.0) AS INT) AS token_count, path LIKE '%.test.ts' AS is_test, doc_id
FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'packages' ELSE 'lib' END || '/' || CASE doc_id % 11 WHEN 0 THEN 'order_factory' WHEN 1 THEN 'user-events' ELSE source END || '/' || lang || '/doc' || CAST(doc_id AS <<string>>) || CASE doc_id % 5 WHEN 0 THEN '.test.ts' WHEN 1 THEN '/index.ts' ELSE '.ts' END AS path FROM {documents}) AS d
"""

#: Files on whose paths every layer, domain and directory rule has something to say.
_FOLDERS = [f"packages/{d}" for d in DOMAINS] + [f"src/{words[0]}/__tests__" for words in LAYERS.values()] + ["docs/guide", "scripts/build"]
SETTINGS = f"""
SELECT path AS id, path, path LIKE '%.spec.ts' AS is_test FROM (
  SELECT CASE doc_id WHEN 0 THEN 'pnpm-lock.yaml' WHEN 1 THEN 'turbo.json' ELSE CASE doc_id % {len(_FOLDERS)} {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS))} END || '/doc' || CAST(doc_id AS <<string>>) || CASE WHEN doc_id % 4 < 3 THEN '.spec.ts' ELSE '.ts' END END AS path FROM {{documents}}) AS d
"""

FUNCTIONS = """
SELECT file_id || ':' || name || CAST(p_partkey AS <<string>>) AS id, name, name AS full_name, file_id, signature, doc_comment, complexity, start_line, end_line, is_exported, false AS is_async, p_partkey AS part_key
FROM (
  SELECT p.p_partkey, f.id AS file_id,
    CASE p.p_partkey % 4
      WHEN 0 THEN lower(split_part(p_name, ' ', 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
      WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
      WHEN 2 THEN lower(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '-') END AS name,
    p_brand AS signature, p_type AS doc_comment, p_size AS complexity, p_size AS start_line, p_size + 10 AS end_line, p_size > 25 AS is_exported
  FROM (SELECT part.*, p_partkey % n AS at_doc FROM {part} AS part CROSS JOIN (SELECT count(*) AS n FROM {documents}) AS c) AS p JOIN {v_files} AS f ON f.doc_id = p.at_doc
) AS x
"""

CLASSES = """
SELECT 'class:' || CAST(s_suppkey AS <<string>>) AS id, s_name AS name, f.id AS file_id, m.methods, <<strings>> AS properties,
  CASE WHEN s_suppkey >= 10 THEN 'class:' || CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS <<string>>) END AS extends_id, <<strings>> AS implements_ids, s_acctbal > 0 AS is_exported
FROM {supplier} AS s JOIN {v_files} AS f ON f.doc_id = s.s_suppkey
JOIN (SELECT l_suppkey, <<sorted_set:v.id>> AS methods FROM {lineitem} AS l JOIN (SELECT * FROM {v_parts}) AS v ON v.p_partkey = l.l_partkey GROUP BY l_suppkey) AS m ON m.l_suppkey = s.s_suppkey
"""

#: Ids of functions by part.
PARTS = "SELECT part_key AS p_partkey, id FROM {v_functions}"

TYPES = """
SELECT 'type:' || CAST(n_nationkey AS <<string>>) AS id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'type' WHEN 2 THEN 'enum' ELSE 'type-alias' END AS kind, f.id AS file_id, <<array:n_name>> AS properties
FROM {nation} AS n JOIN {v_files} AS f ON f.doc_id = n.n_nationkey
"""

#: A tree: regions over nations over customers and suppliers.
EDGES = """
SELECT 'r' || CAST(n_regionkey AS <<string>>) AS source, 'n' || CAST(n_nationkey AS <<string>>) AS target, 'nation' AS type, 'rn' || CAST(n_nationkey AS <<string>>) AS id FROM {nation}
UNION ALL SELECT 'n' || CAST(c_nationkey AS <<string>>), 'c' || CAST(c_custkey AS <<string>>), 'customer', 'nc' || CAST(c_custkey AS <<string>>) FROM {customer}
UNION ALL SELECT 'n' || CAST(s_nationkey AS <<string>>), 's' || CAST(s_suppkey AS <<string>>), 'supplier', 'ns' || CAST(s_suppkey AS <<string>>) FROM {supplier}
"""

NODES = """
SELECT 'r' || CAST(r_regionkey AS <<string>>) AS id, 'region' AS type, r_name AS label FROM {region}
UNION ALL SELECT 'n' || CAST(n_nationkey AS <<string>>), 'nation', n_name FROM {nation}
UNION ALL SELECT 'c' || CAST(c_custkey AS <<string>>), 'customer', c_name FROM {customer}
UNION ALL SELECT 's' || CAST(s_suppkey AS <<string>>), 'supplier', s_name FROM {supplier}
"""

VECTORS = "SELECT CAST(vec_id AS <<string>>) AS entity_id, 'function' AS entity_type, embedding, vec_id, label FROM {embeddings}"

FEEDBACK = "SELECT CAST(doc_id AS <<string>>) AS id, 'ctx' || CAST(doc_id % 50 AS <<string>>) AS context_id, 1 + 4 * quality AS rating, toxic = 1 AS rejected, doc_id FROM {labels}"

CHANGES = "SELECT event_id AS seq, ts, 'user' || CAST(user_id AS <<string>>) AS path, CASE event_id % 5 WHEN 0 THEN 'add' WHEN 4 THEN 'unlink' ELSE 'change' END AS op, value, event_type FROM {events}"

VIEWS = {"v_files": FILES, "v_settings": SETTINGS, "v_functions": FUNCTIONS, "v_parts": PARTS, "v_classes": CLASSES, "v_types": TYPES, "v_edges": EDGES, "v_nodes": NODES, "v_vectors": VECTORS, "v_feedback": FEEDBACK, "v_changes": CHANGES}

#: How a view is joined. A hash of the parts' ids saves sorting all that meets them.
HINTS = {"v_parts": "shuffle_hash"}


def _filled(sql: str, dialect: str) -> str:
    import re

    names = _DIALECT[dialect]
    return re.sub(r"<<(\w+)(?::([^>]*))?>>", lambda m: names[m[1]].format(m[2] or ""), sql)


def _inputs(sql: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """The views of a folder of tables, made as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                sql = _filled(VIEWS[name], "spark")
                made = self.spark.sql(sql, **{x: self[x] for x in _inputs(sql)})
                self.made[name] = made.hint(HINTS[name]) if name in HINTS else made
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def duckdb_ctes(*names: str) -> str:
    """`WITH` and the named views with all that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for x in _inputs(VIEWS[name]):
                add(x)
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({_filled(VIEWS[n], 'duckdb').strip()})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts).replace("{", "").replace("}", "")
