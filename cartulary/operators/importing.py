"""Import resolution: specifiers against the indexed files, as one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.constants import IMPORT_EXTENSIONS


def normalized(path: Column) -> Column:
    """A path without `.`, empty and `..` segments; `..` beyond the root stays."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1))
        .otherwise(F.concat(done, F.array(part))))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, part: F.when(F.size(done) == 0, F.when((part == "") | (part == "."), done).otherwise(F.array(part))).otherwise(step(done, part))), "/")


def candidates(from_path: Column, spec: Column, js_to_ts: bool = False) -> Column:
    """Array of the paths that a specifier may mean, in order. js_to_ts: `./x.js` may also be x.ts."""
    folder = F.when(from_path.contains("/"), F.regexp_replace(from_path, "/[^/]*$", "/")).otherwise("")
    base = normalized(F.concat(folder, spec))
    own = [F.when(base.endswith(e), base).otherwise(F.concat(base, F.lit(e))) for e in IMPORT_EXTENSIONS]
    index = [F.concat(base, F.lit(f"/index{e}")) for e in IMPORT_EXTENSIONS]
    more = [F.when(base.endswith(".js"), F.regexp_replace(base, r"\.js$", e)) for e in (".ts", ".tsx")] if js_to_ts else []
    return F.array(*own, *index, *more)


def concerned(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(from_path) of the relative imports (from_path, spec) that may mean one of the paths (path)."""
    relative = imports.filter(F.col("spec").startswith("."))
    tried = relative.select("from_path", F.explode(candidates(F.col("from_path"), F.col("spec"))).alias("path"))
    return tried.join(paths.select("path"), "path", "left_semi").select("from_path").distinct()


def resolve(imports: DataFrame, files: DataFrame, js_to_ts: bool = False) -> DataFrame:
    """imports (from_path, spec) -> (from_path, spec, to_path) of the relative ones that resolve: the first candidate that is a file.

    All files are known when the join runs, so the order of indexing doesn't matter.
    """
    relative = imports.filter(F.col("spec").startswith(".")).select("from_path", "spec").distinct()
    tried = relative.select("from_path", "spec", F.posexplode(candidates(F.col("from_path"), F.col("spec"), js_to_ts)).alias("i", "path")).filter("path is not null")
    hits = tried.join(files.select("path"), "path")
    return hits.groupBy("from_path", "spec").agg(F.min_by("path", "i").alias("to_path"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """Relationship rows of resolved imports (file ids are paths)."""
    return resolved.select(
        F.concat("from_path", F.lit(":imports:"), "to_path").alias("id"), F.col("from_path").alias("source_id"), F.col("to_path").alias("target_id"), F.lit("imports").alias("relation_type"),
        F.create_map(F.lit("specifier"), F.col("spec")).alias("metadata")).dropDuplicates(["id"])


def heritage_edges(classes: DataFrame) -> DataFrame:
    """Relationship rows of extends and implements."""
    bases = classes.select("id", F.explode(F.concat(
        F.when(F.col("extends_id").isNotNull(), F.array(F.struct(F.lit("extends").alias("k"), F.col("extends_id").alias("t")))).otherwise(F.array().cast("array<struct<k:string,t:string>>")),
        F.transform(F.coalesce("implements_ids", F.array().cast("array<string>")), lambda t: F.struct(F.lit("implements").alias("k"), t.alias("t"))))).alias("b"))
    return bases.select(F.concat("id", F.lit(":"), "b.k", F.lit(":"), "b.t").alias("id"), F.col("id").alias("source_id"), F.col("b.t").alias("target_id"), F.col("b.k").alias("relation_type"), F.create_map().cast("map<string,string>").alias("metadata")).dropDuplicates(["id"])
