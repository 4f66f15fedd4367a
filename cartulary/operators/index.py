"""Indexing: scan, compare, parse what changed, store.

Files are compared by hash before parsing, so unchanged contents never reach Python. Imports are resolved against all files in
one join, those of unchanged files again where a file that they may mean has come or gone, so neither order nor earlier runs matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators import importing, parsing, store
from cartulary.operators.embedding import Model, embed, entity_texts
from cartulary.operators.parsing import Parser
from cartulary.scratch import scratch, written


def _apply(target: store.Store, sources: DataFrame, gone: DataFrame, registry: dict[str, Parser] | None, model: Model | None) -> int:
    """Replaces what the store has of the sources' files, and deletes those in gone (id). Returns how many files couldn't be parsed.

    Only the buckets of these files are rewritten, and those of files whose imports may resolve otherwise now, as one of the places
    that they may mean is a file that has come or gone.
    """
    with scratch():
        sources = written(sources.select("path", "content"), "sources")
        parsed = written(parsing.parse_sources(sources, registry), "parsed")
        found = parsing.entities(parsed)
        replaced = sources.select(F.col("path").alias("id")).union(gone.select("id")).distinct()
        everything, touched = target.tables(), target.buckets("files", replaced)
        before = target.tables(touched)
        kept = store.without_files(before, replaced)
        new_files = parsing.file_rows(sources)

        old = everything["files"].select("path")
        came = new_files.select("path").join(old, "path", "left_anti")
        went = gone.select(F.col("id").alias("path")).join(old, "path", "left_semi")
        others = everything["imports"].join(replaced.select(F.col("id").alias("from_path")), "from_path", "left_anti")
        concerned = written(importing.concerned(others, came.union(went)).union(new_files.select(F.col("path").alias("from_path"))).distinct(), "concerned")
        edges_touched = sorted({*touched, *target.buckets("imports", concerned)})

        files = everything["files"].join(replaced, "id", "left_anti").select("path").union(new_files.select("path"))
        specs = others.unionByName(found["imports"]).join(concerned, "from_path", "left_semi")
        resolved = importing.import_edges(importing.resolve(specs, files))
        stale = concerned.select(F.col("from_path").alias("source_id"), F.lit("imports").alias("relation_type"))
        edges = store.without_files({**before, "relationships": target.table("relationships", edges_touched)}, replaced)["relationships"]
        edges = edges.join(stale, ["source_id", "relation_type"], "left_anti").select(edges.columns)
        changed = {
            "files": kept["files"].unionByName(new_files), "imports": kept["imports"].unionByName(found["imports"]),
            "relationships": edges.unionByName(resolved).unionByName(importing.heritage_edges(found["classes"])),
            **{t: kept[t].unionByName(found[t].select(kept[t].columns)) for t in store.CHILDREN}, "embeddings": kept["embeddings"],
        }
        if model is not None:
            changed["embeddings"] = kept["embeddings"].unionByName(embed(entity_texts(found["functions"], found["classes"]), model))
        target.write(changed, dict.fromkeys(changed, touched) | {"relationships": edges_touched})
        return parsed.filter("error is not null").count()


def index(target: store.Store, sources: DataFrame, purge: bool = True, force: bool = False, registry: dict[str, Parser] | None = None, model: Model | None = None) -> dict[str, int]:
    """Brings the store to the state of sources (path, content). Returns counts by status, and of errors.

    purge: files that aren't among the sources any more are deleted. force: unchanged files are parsed too.
    """
    spark = sources.sparkSession
    with scratch():
        hashed = sources.withColumn("content_hash", F.sha2("content", 256))
        changes = written(store.diff(hashed, target.table("files"), deleted=True), "changes")
        counts = {r.status: r.n for r in store.progress(changes).collect()}
        wanted = changes.filter(F.col("status").isin("new", "changed", *(["unchanged"] if force else []))).select("path")
        gone = changes.filter("status = 'deleted'").select(F.col("path").alias("id")) if purge else spark.createDataFrame([], "id string")
        if not purge:
            counts.pop("deleted", None)
        errors = 0
        if any(counts.get(k) for k in ("new", "changed", "deleted")) or force:
            errors = _apply(target, sources.join(wanted, "path", "left_semi").select("path", "content"), gone, registry, model)
    return counts | {"errors": errors}


def index_changes(target: store.Store, changes: DataFrame, registry: dict[str, Parser] | None = None, model: Model | None = None) -> int:
    """Applies rows (op, path, content, seq): the last row of each path counts. Doing so twice changes nothing. Returns how many files couldn't be parsed."""
    with scratch():
        last = written(store.latest(changes.select("op", "path", "content", "seq"), ["path"], "seq"), "last-changes")
        return _apply(target, last.filter("op <> 'unlink'").select("path", "content"), last.filter("op = 'unlink'").select(F.col("path").alias("id")), registry, model)
