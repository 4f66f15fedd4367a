"""Entity tables and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 4

FILES = "id string, path string, language string, content_hash string, token_count int, is_test boolean, last_indexed_at timestamp"
FUNCTIONS = "id string, name string, full_name string, file_id string, signature string, doc_comment string, complexity int, start_line int, end_line int, is_exported boolean, is_async boolean"
CLASSES = "id string, name string, file_id string, methods array<string>, properties array<string>, extends_id string, implements_ids array<string>, is_exported boolean"
TYPES = "id string, name string, kind string, file_id string, properties array<string>"
RELATIONSHIPS = "id string, source_id string, target_id string, relation_type string, metadata map<string,string>"
FEEDBACK = "id string, query string, context_id string, rating int, accepted_items array<string>, rejected_items array<string>, created_at timestamp"
#: What each file imports, resolved or not, so that a target that comes later is found.
IMPORTS = "from_path string, spec string"
EMBEDDINGS = "entity_id string, entity_type string, embedding array<float>"

#: Table name -> schema.
TABLES = {"files": FILES, "functions": FUNCTIONS, "classes": CLASSES, "types": TYPES, "relationships": RELATIONSHIPS, "imports": IMPORTS, "feedback": FEEDBACK, "embeddings": EMBEDDINGS}
_GRAMS = "gram string, n int, ids array<string>, of_bucket int"
#: What the store derives from tables and writes with them: posting lists of grams, and relationships by their targets.
DERIVED = {"function_grams": _GRAMS, "file_grams": _GRAMS, "relationships_in": RELATIONSHIPS}
#: Table name -> key columns. A file's key is its path.
KEYS = {"files": ["path"], "functions": ["id"], "classes": ["id"], "types": ["id"], "relationships": ["id"], "imports": ["from_path", "spec"], "feedback": ["id"], "embeddings": ["entity_id"]}

# Fixed values of the data model.
TYPE_KINDS = ("interface", "type", "enum", "type-alias")
RELATION_KINDS = ("calls", "imports", "extends", "implements", "uses_type", "has_function", "has_test")


def check(table: str) -> Column | None:
    """What rows of the table must fulfil, if anything."""
    return {
        "types": F.col("kind").isin(*TYPE_KINDS),
        "relationships": F.col("relation_type").isin(*RELATION_KINDS),
        "feedback": F.col("rating").between(1, 5),
    }.get(table)


def checked(table: str, df: DataFrame) -> DataFrame:
    """df, failing at run time on a row that breaks the table's check."""
    ok = check(table)
    if ok is None:
        return df
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.concat(F.lit(f"check of {table} failed: "), F.coalesce(F.col(first), F.lit("null"))))))


def with_defaults(table: str, df: DataFrame) -> DataFrame:
    """df with the table's columns and types; missing ones null; null texts and arrays empty, as readers expect."""
    out = {}
    for part in _columns(TABLES[table]):
        name, kind = part
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in ("signature", "doc_comment"):
            c = F.coalesce(c, F.lit(""))
        elif kind == "array<string>":
            c = F.coalesce(c, F.array().cast(kind))
        out[name] = c
    return df.select(*(c.alias(n) for n, c in out.items()))


def _columns(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]
