"""Retrieval: keyword search, vector search, their merge, and sections under a token budget.

A query is one string on the driver; only the predicates made from it reach Spark. Limits have a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import dot_product, expand_query_py, keywords_py, like_any, match_score, normalize_query_py, token_estimate
from cartulary.operators.ordinals import numbered

# Fixed values in the sections below: titles, line formats, numbers of rows shown, relevances.
TABLE_ORDER = ("file_id", "start_line", "id")


def search_functions(functions: DataFrame, query: str, limit: int = 20, rank: str = "score") -> DataFrame:
    """Functions whose name, full name or comment has a keyword of the query (or the whole query, if none is left), with score and rank.

    rank "score": best first. rank "table": in table order. Both are a top-k, never a full sort.
    """
    words = keywords_py(query) or [query]
    found = functions.filter(like_any([F.col("name"), F.col("full_name"), F.col("doc_comment")], words))
    found = found.withColumn("score", match_score(query, *(F.col(c) for c in ("name", "full_name", "doc_comment", "signature", "is_exported"))))
    order = ([F.col("score").desc()] if rank == "score" else []) + [F.col(c) for c in TABLE_ORDER]
    return found.orderBy(*order).limit(limit)


def search_files(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    words = keywords_py(query) or [query]
    return files.filter(like_any([F.col("path")], words)).orderBy("path").limit(limit)


def vector_top_k(embeddings: DataFrame, query: list[float] | Column, k: int, entity_type: str | None = "function") -> DataFrame:
    """entity_id and score of the k vectors with the largest dot product; the scan is the only stage, each task keeps k rows."""
    rows = embeddings if entity_type is None else embeddings.filter(F.col("entity_type") == entity_type)
    vector = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return rows.select("entity_id", dot_product(F.col("embedding"), vector).alias("score")).orderBy(F.col("score").desc(), "entity_id").limit(k)


def hybrid_merge(keyword: DataFrame, vector: DataFrame, limit: int = 10) -> DataFrame:
    """keyword and vector (id, pos: rank in the list): ids of both lists first, then keyword's, then vector's, each by rank."""
    k = keyword.groupBy("id").agg(F.min("pos").alias("keyword_pos"))
    v = vector.groupBy("id").agg(F.min("pos").alias("vector_pos"))
    both = k.join(v, "id", "full_outer")
    bucket = F.when(F.col("keyword_pos").isNull(), 2).when(F.col("vector_pos").isNull(), 1).otherwise(0)
    return both.withColumn("bucket", bucket).orderBy("bucket", F.coalesce("keyword_pos", "vector_pos"), "id").limit(limit)


def token_budget(sections: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """sections (pos, tokens, ...) with running total and kept; those that don't fit still count.

    by: columns of the group (one query's sections each); groups may be of any size, and pos should be unique in them. Without, the
    sections are those of one query, a handful.
    """
    if by:
        out = numbered(sections, by, ["pos"], "_pos", {"running": "tokens"}).drop("_pos")
    else:
        out = sections.withColumn("running", F.sum("tokens").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("kept", F.col("running") <= budget)


def _bullets(rows: DataFrame, order: list[str], line: Column, head: str, limit: int, source: str, relevance: Column, title: str, pos: int) -> DataFrame:
    """One section (or no row) from at most `limit` shown rows; sources are of all rows."""
    w = Window.orderBy(*order)  # rows are at most a few hundred: those of ten functions' files
    numbered = rows.withColumn("_n", F.row_number().over(w)).withColumn("_line", line)
    agg = numbered.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= limit, F.struct("_n", "_line")))), lambda x: x["_line"]), "").alias("body"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(source).alias("s")))), lambda x: x["s"])).alias("source_files"),
        relevance.alias("relevance"), F.count(F.lit(1)).alias("rows"))
    content = F.concat(F.lit(head), "body")
    return agg.filter("rows > 0").select(F.lit(pos).alias("pos"), F.lit(title).alias("title"), content.alias("content"), "source_files", F.col("relevance").cast("double").alias("relevance"), token_estimate(content).alias("tokens"))


def function_section(functions: DataFrame) -> DataFrame:
    """functions: ranked rows with pos and score."""
    line = F.concat(
        F.lit("### "), "full_name", F.lit("\n- **Location:** "), "file_id", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit("\n- **Signature:** `"), "signature", F.lit("`\n"),
        F.when(F.coalesce("doc_comment", F.lit("")) != "", F.concat(F.lit("- **Doc:** "), F.substring("doc_comment", 1, 200), F.lit("\n"))).otherwise(""),
        F.lit("- **Exported:** "), F.when(F.col("is_exported"), "Yes").otherwise("No"), F.lit("\n- **Complexity:** "), "complexity", F.lit("\n\n"))
    shown = F.sum(F.when(F.col("_n") <= 8, F.col("score")).otherwise(0.0)) / F.count(F.lit(1))
    return _bullets(functions, ["pos"], line, "## Relevant Functions\n\n", 8, "file_id", shown, "Relevant Functions", 1)


def file_section(files: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- **"), "path", F.lit("** — "), "language", F.lit(", "), "token_count", F.lit(" tokens"), F.when(F.col("is_test"), " (test)").otherwise(""), F.lit("\n"))
    return _bullets(files, ["path"], line, "## Related Files\n\n", 8, "path", F.max(F.lit(0.5)), "Related Files", 2)


def class_section(classes: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("methods", lambda m: F.substring_index(m, ":", -1)), ", ")
    line = F.concat(
        F.lit("### "), "name", F.lit("\n"), F.when(F.coalesce("extends_id", F.lit("")) != "", F.concat(F.lit("- **Extends:** "), F.substring_index("extends_id", ":", -1), F.lit("\n"))).otherwise(""),
        F.when(F.size("methods") > 0, F.concat(F.lit("- **Methods:** "), names, F.lit("\n"))).otherwise(""), F.lit("\n"))
    return _bullets(classes, ["file_pos", "id"], line, "## Related Classes\n\n", 5, "file_id", F.max(F.lit(0.6)), "Related Classes", 3)


def type_section(types: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- **"), "name", F.lit("** ("), "kind", F.lit(")\n"), F.when(F.size("properties") > 0, F.concat(F.lit("  - Properties: "), F.array_join("properties", ", "), F.lit("\n"))).otherwise(""))
    return _bullets(types, ["file_pos", "id"], line, "## Related Types\n\n", 5, "file_id", F.max(F.lit(0.4)), "Related Types", 4)


def find_context(tables: dict[str, DataFrame], query: str, max_tokens: int = 4000, query_vector: list[float] | None = None, rank: str = "score", searched: dict[str, DataFrame] | None = None, nearest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections with running total and kept, ranked functions) for a query; a query vector adds vector search.

    searched: functions and files that an index left to be searched for the query's words, by default all. nearest: the eight
    functions (entity_id, score) nearest to the vector, if an index found them."""
    text = expand_query_py(normalize_query_py(query))
    hybrid = query_vector is not None
    searched = tables | (searched or {})
    found = search_functions(searched["functions"], text, 8 if hybrid else 10, rank)
    order = ([F.col("score").desc()] if rank == "score" else []) + [F.col(c) for c in TABLE_ORDER]
    ranked = found.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    if hybrid:
        near = vector_top_k(tables["embeddings"], query_vector, 8) if nearest is None else nearest
        near = near.join(tables["functions"].select(F.col("id").alias("entity_id")), "entity_id")
        near = near.select(F.col("entity_id").alias("id"), F.row_number().over(Window.orderBy(F.col("score").desc(), "entity_id")).alias("pos"))
        merged = hybrid_merge(ranked.select("id", "pos"), near)
        merged = merged.select("id", F.row_number().over(Window.orderBy("bucket", F.coalesce("keyword_pos", "vector_pos"), "id")).alias("pos"))
        score = match_score(text, *(F.col(c) for c in ("name", "full_name", "doc_comment", "signature", "is_exported")))
        ranked = tables["functions"].join(F.broadcast(merged), "id").withColumn("score", score)  # at most ten ids
    places = ranked.groupBy("file_id").agg(F.min("pos").alias("file_pos"))
    parts = [
        function_section(ranked), file_section(search_files(searched["files"], text, 10)),
        class_section(tables["classes"].join(F.broadcast(places), "file_id")), type_section(tables["types"].join(F.broadcast(places), "file_id")),
    ]
    return token_budget(reduce(DataFrame.unionByName, parts), max_tokens), ranked


def file_context(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """One row (title, content, source_files, relevance) for a file, or none."""
    f = tables["files"].filter(F.col("path") == path)
    return file_contexts(f, tables).select(F.concat(F.lit("File: "), "path").alias("title"), "content", F.array("path").alias("source_files"), F.lit(1.0).alias("relevance"))


def file_contexts(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """files with a column content: what is known of each file. The children are grouped by file and joined, never looked up one by one."""
    def lines(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
        rows = rows.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("id").alias("i"), line.alias("l")))), lambda x: x["l"]), "")
        return rows.groupBy("file_id").agg(body.alias(name))

    names = F.array_join(F.transform("methods", lambda m: F.substring_index(m, ":", -1)), ", ")
    of_class = F.concat(F.lit("- "), "name", F.when(F.coalesce("extends_id", F.lit("")) != "", F.concat(F.lit(" extends "), F.substring_index("extends_id", ":", -1))).otherwise(""), F.lit("\n"), F.when(F.size("methods") > 0, F.concat(F.lit("  - Methods: "), names, F.lit("\n"))).otherwise(""))
    of_function = F.concat(F.lit("- "), "full_name", F.lit(": "), "signature", F.lit("\n"), F.when(F.coalesce("doc_comment", F.lit("")) != "", F.concat(F.lit("  - "), F.substring_index("doc_comment", "\n", 1), F.lit("\n"))).otherwise(""))
    of_type = F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")\n"))
    out = files
    for table, order, line, name in (("classes", "id", of_class, "c"), ("functions", "start_line", of_function, "f"), ("types", "id", of_type, "t")):
        out = out.join(lines(tables[table], order, line, name), out["id"] == F.col("file_id"), "left").drop("file_id")
    part = lambda title, c: F.coalesce(F.concat(F.lit(f"### {title}\n\n"), c, F.lit("\n")), F.lit(""))
    content = F.concat(
        F.lit("## File: "), "path", F.lit("\n\nLanguage: "), "language", F.lit("\nToken count: "), "token_count", F.lit("\nIs test: "), F.col("is_test").cast("string"), F.lit("\n\n"),
        part("Classes", "c"), part("Functions", "f"), part("Types", "t"))
    return out.withColumn("content", content).drop("c", "f", "t")
