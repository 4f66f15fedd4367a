"""Parsing: source texts to entities, by a registry of parsers under one Arrow-batched map."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.constants import LANGUAGES
from cartulary.operators.parsing import go, python, python_ast, rust, typescript
from cartulary.operators.parsing.common import Parsed

#: (path, content) -> Parsed.
Parser = Callable[[str, str], Parsed]

REGISTRY: dict[str, Parser] = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), typescript.parse), **dict.fromkeys((".py", ".pyw"), python.parse), ".go": go.parse, ".rs": rust.parse,
}

_FUNCTION = "struct<file_id:string,name:string,full_name:string,signature:string,doc_comment:string,complexity:int,start_line:int,end_line:int,is_exported:boolean,is_async:boolean>"
_CLASS = "struct<file_id:string,name:string,methods:array<string>,properties:array<string>,extends_id:string,implements_ids:array<string>,is_exported:boolean>"
_TYPE = "struct<file_id:string,name:string,kind:string,properties:array<string>>"
SCHEMA = f"path string, functions array<{_FUNCTION}>, classes array<{_CLASS}>, types array<{_TYPE}>, imports array<string>, error string"


def tree_registry() -> dict[str, Parser]:
    """The registry with syntax trees where a grammar is at hand (Python's own); other languages keep their parser."""
    return REGISTRY | dict.fromkeys((".py", ".pyw"), python_ast.parse)


def language(path: F.Column) -> F.Column:
    ext = F.regexp_extract(path, r"\.[^./]+$", 0)
    out = F.lit("unknown")
    for k, v in LANGUAGES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def is_test(path: F.Column) -> F.Column:
    lang = language(path)
    return (
        F.when(lang == "python", path.contains("test_") | path.contains("_test"))
        .when(lang == "go", path.endswith("_test.go"))
        .when(lang == "rust", path.contains("test"))
        .otherwise(path.endswith(".test.ts") | path.endswith(".spec.ts") | path.endswith(".test.tsx")))


def parse_sources(sources: DataFrame, registry: dict[str, Parser] | None = None) -> DataFrame:
    """sources (path, content) -> SCHEMA. A file that can't be parsed has its error and no entities."""
    parsers = registry or REGISTRY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    found, error = parsers[os.path.splitext(path)[1]](path, content or ""), None
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    found, error = Parsed(), f"{type(e).__name__}: {e}"
                rows.append((path, found.functions, found.classes, found.types, found.imports, error))
            yield pd.DataFrame(rows, columns=["path", "functions", "classes", "types", "imports", "error"])

    return sources.select("path", "content").mapInPandas(run, SCHEMA)


def entities(parsed: DataFrame) -> dict[str, DataFrame]:
    """functions, classes and types tables, and imports (from_path, spec), from parse_sources(). Of several entities with one id the last counts."""
    def exploded(column: str, name: str) -> DataFrame:
        rows = parsed.select(F.posexplode(column).alias("seq", "e")).select("seq", "e.*")
        rows = rows.withColumn("id", F.concat("file_id", F.lit(":"), name))
        last = F.max_by(F.struct(*(c for c in rows.columns if c not in ("id", "seq"))), "seq")
        return rows.groupBy("id").agg(last.alias("e")).select("id", "e.*")

    return {
        "functions": exploded("functions", "full_name"), "classes": exploded("classes", "name"), "types": exploded("types", "name"),
        "imports": parsed.select(F.col("path").alias("from_path"), F.explode("imports").alias("spec")).distinct(),
    }


def file_rows(sources: DataFrame) -> DataFrame:
    """The files table of sources (path, content)."""
    return sources.select(
        F.col("path").alias("id"), "path", language(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), F.ceil(F.length("content") / 4).cast("int").alias("token_count"),
        is_test(F.col("path")).alias("is_test"), F.current_timestamp().alias("last_indexed_at"))
