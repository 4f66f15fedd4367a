"""Architecture: modules with cohesion and coupling, and the concepts (layers, patterns, domains) that paths suggest."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.constants import DOMAINS, LAYERS, PATTERNS
from cartulary.functions.text import contains_any, module_name, percent, round2, short_id
from cartulary.operators.mentions import mentions

#: Concepts list their first files; a module's own list is whole.
SHOWN_FILES = 10
#: Export sets of a module with one name beyond which their pairs are compared in blocks, and sets of a block, about.
HOT_SETS, SET_BLOCK = 200, 512


def module_members(files: DataFrame) -> DataFrame:
    """(root_path, file_id, path): each file under its two first path segments, below packages/ also under three. Files at the root belong to none."""
    parts = F.split("path", "/")
    two = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, 2), "/"))
    three = F.when((parts[0] == "packages") & (F.size(parts) >= 3), F.array_join(F.slice(parts, 1, 3), "/"))
    keys = F.explode(F.array_compact(F.array(two, three)))
    return files.select(keys.alias("root_path"), F.col("id").alias("file_id"), "path")


def large_modules(members: DataFrame) -> DataFrame:
    """(root_path, n_files) of modules with two files at least."""
    return members.groupBy("root_path").agg(F.count(F.lit(1)).alias("n_files")).filter("n_files >= 2")


def file_exports(functions: DataFrame) -> DataFrame:
    """(file_id, full_name): distinct exported names of each file."""
    return functions.filter("is_exported").select("file_id", "full_name").distinct()


def cohesion(members: DataFrame, exports: DataFrame) -> DataFrame:
    """(root_path, cohesion): mean Jaccard similarity of the export sets of a module's file pairs.

    Files of a module with the same set count as one set, times their number. Only pairs of sets that share a name add to the mean;
    all other pairs count in the denominator n(n-1)/2. Pairs that share a hot name (one that over HOT_SETS sets of the module have)
    are never made: their sets are cut into blocks, and a task for two blocks returns one sum. All other pairs are made by joining
    on module and name.
    """
    sets = exports.groupBy("file_id").agg(F.array_sort(F.collect_set("full_name")).alias("names"))
    alike = members.join(sets, "file_id").groupBy("root_path", "names").agg(F.count(F.lit(1)).alias("files")).withColumn("key", F.sha2(F.to_json("names"), 256))
    holders = alike.select("root_path", F.explode("names").alias("full_name")).groupBy("root_path", "full_name").agg(F.count(F.lit(1)).alias("n"))
    hot = holders.filter(F.col("n") > HOT_SETS).groupBy("root_path").agg(F.collect_set("full_name").alias("hot"))
    alike = alike.join(hot, "root_path", "left").withColumn("hot", F.array_intersect("names", F.coalesce("hot", F.array().cast("array<string>"))))
    named = alike.select("root_path", "key", "files", F.size("names").alias("exports"), "hot", F.explode(F.array_except("names", "hot")).alias("full_name"))
    other = named.select("root_path", "full_name", F.col("key").alias("key_b"), F.col("files").alias("files_b"), F.col("exports").alias("exports_b"), F.col("hot").alias("hot_b"))
    shared = named.join(other, ["root_path", "full_name"]).filter((F.col("key") < F.col("key_b")) & ~F.arrays_overlap("hot", "hot_b")).groupBy("root_path", "key", "key_b").agg(
        F.count(F.lit(1)).alias("common"), F.first(F.col("files") * F.col("files_b")).alias("times"), F.first(F.col("exports") + F.col("exports_b")).alias("both"))
    within = alike.select("root_path", (F.col("files") * (F.col("files") - 1) / 2).alias("similarity"))
    across = shared.select("root_path", (F.col("times") * F.col("common") / (F.col("both") - F.col("common"))).alias("similarity"))
    total = within.union(across).union(_hot_pairs(alike)).groupBy("root_path").agg(F.sum("similarity").alias("similarity"))
    pairs = F.col("n_files") * (F.col("n_files") - 1) / 2
    return large_modules(members).join(total, "root_path", "left").select("root_path", (F.coalesce("similarity", F.lit(0.0)) / pairs).alias("cohesion"))


def _hot_pairs(sets: DataFrame) -> DataFrame:
    """(root_path, similarity): sums over the pairs of a module's sets (root_path, key, names, hot, files) that share a hot name, a row for two blocks."""
    some = sets.filter(F.size("hot") > 0)
    blocks = some.groupBy("root_path").agg(F.ceil(F.count(F.lit(1)) / SET_BLOCK).cast("int").alias("blocks"))
    cut = some.join(blocks, "root_path").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    with_each = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = with_each.select("root_path", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "names", "hot", "files")
    return rows.groupBy("root_path", "i", "j").applyInArrow(_block_similarity, "root_path string, similarity double")


def _block_similarity(t: pa.Table) -> pa.Table:
    """The sum of files * files * Jaccard over pairs of sets of the two blocks (of one block: each pair once) with a hot name in common."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    block, files = t.column("block").to_numpy(), t.column("files").to_numpy().astype(np.float64)
    sizes = {c: pc.list_value_length(t.column(c)).to_numpy().astype(np.int64) for c in ("names", "hot")}
    flat = {c: pc.list_flatten(t.column(c)).combine_chunks() for c in ("names", "hot")}
    known = pc.unique(flat["names"])
    ids = {c: pc.index_in(flat[c], known).to_numpy(zero_copy_only=False).astype(np.int64) for c in flat}
    first = {c: np.concatenate([[0], np.cumsum(sizes[c])]) for c in flat}
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    place = np.full(len(block), -1)
    place[left] = np.arange(len(left))

    def by_name(c: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each name the left sets that have it: their places in order of names, and where each name starts."""
        of = place[np.repeat(np.arange(len(block)), sizes[c])]
        order = np.argsort(ids[c][of >= 0], kind="stable")
        return of[of >= 0][order], np.concatenate([[0], np.cumsum(np.bincount(ids[c][of >= 0], minlength=len(known)))])

    held = {c: by_name(c) for c in flat}

    def common(c: str, r: int) -> np.ndarray:
        of, starts = held[c]
        return np.bincount(np.concatenate([of[starts[n] : starts[n + 1]] for n in ids[c][first[c][r] : first[c][r + 1]]]), minlength=len(left))

    total = 0.0
    for r in right:
        hit = common("hot", r) > 0
        if i == j:
            hit[place[r] :] = False
        if hit.any():
            n = common("names", r)[hit]
            total += files[r] * float((files[left][hit] * n / (sizes["names"][left][hit] + sizes["names"][r] - n)).sum())
    return pa.table({"root_path": pa.array([t.column("root_path")[0].as_py()], pa.string()), "similarity": pa.array([total], pa.float64())})


def coupling(members: DataFrame, exports: DataFrame, functions: DataFrame) -> DataFrame:
    """(root_path, coupling): the share of a module's exports that some function outside mentions (in name, full name or comment, as keyword search would find it).

    A name is outside a module if one of the files that mention it is.
    """
    names = exports.select("full_name", F.lower("full_name").alias("word")).distinct()
    by_file = mentions(names.select("word"), functions).join(names, "word").select("full_name", "file_id")
    # Files of a mention, and those of them inside each module: a name has a mention outside if there are more of the former.
    everywhere = by_file.groupBy("full_name").agg(F.count(F.lit(1)).alias("files"))
    inside = by_file.join(members.select("root_path", "file_id"), "file_id").groupBy("root_path", "full_name").agg(F.count(F.lit(1)).alias("inside"))
    owned = members.join(exports, "file_id").select("root_path", "file_id", "full_name")
    refs = owned.join(everywhere, "full_name").join(inside, ["root_path", "full_name"], "left")
    outside = F.col("files") > F.coalesce("inside", F.lit(0))
    rate = refs.groupBy("root_path").agg(F.count_if(outside).alias("outside"), F.count(F.lit(1)).alias("exports"))
    return large_modules(members).join(rate, "root_path", "left").select("root_path", F.coalesce(F.col("outside") / F.col("exports"), F.lit(0.0)).alias("coupling"))


def submodules(members: DataFrame) -> DataFrame:
    """(root_path, sub_path): modules of two files or more directly below another; a module of three segments lies below that of its first two."""
    large = large_modules(members).select(F.col("root_path").alias("sub_path"))
    parts = F.split("sub_path", "/")
    return large.filter(F.size(parts) == 3).select(F.array_join(F.slice(parts, 1, 2), "/").alias("root_path"), "sub_path")


def module_exports(members: DataFrame, exports: DataFrame) -> DataFrame:
    """(root_path, exports): distinct exported names, sorted; only of modules that have some."""
    return members.join(exports, "file_id").groupBy("root_path").agg(F.array_sort(F.collect_set("full_name")).alias("exports"))


def module_imports(members: DataFrame, relationships: DataFrame) -> DataFrame:
    """(root_path, imports): distinct files outside that a module's files import, sorted; only of modules that have some."""
    targets = relationships.filter("relation_type = 'imports'").select(F.col("source_id").alias("file_id"), "target_id")
    used = members.join(targets, "file_id").select("root_path", "target_id").distinct()
    foreign = used.join(members.select("root_path", F.col("file_id").alias("target_id")), ["root_path", "target_id"], "left_anti")
    return foreign.groupBy("root_path").agg(F.array_sort(F.collect_set("target_id")).alias("imports"))


def modules(files: DataFrame, functions: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """Modules with id, name, root_path, files, exports, imports, sub_modules, cohesion and coupling; arrays are sorted."""
    members = module_members(files)
    exports = file_exports(functions)
    base = large_modules(members)
    listed = members.groupBy("root_path").agg(F.array_sort(F.collect_list("path")).alias("files"))
    exported = module_exports(members, exports)
    subs = submodules(members).groupBy("root_path").agg(F.array_sort(F.collect_set("sub_path")).alias("sub_modules"))
    out = base.join(listed, "root_path").join(exported, "root_path", "left").join(subs, "root_path", "left")
    if relationships is not None:
        out = out.join(module_imports(members, relationships), "root_path", "left")
    else:
        out = out.withColumn("imports", F.array().cast("array<string>"))
    out = out.join(cohesion(members, exports), "root_path").join(coupling(members, exports, functions), "root_path")
    empty = F.array().cast("array<string>")
    return out.select(
        short_id(F.col("root_path")).alias("id"), module_name(F.col("root_path")).alias("name"), "root_path", "files", *(F.coalesce(c, empty).alias(c) for c in ("exports", "imports", "sub_modules")),
        round2(F.col("cohesion")).alias("cohesion"), round2(F.col("coupling")).alias("coupling"))


def _first(df: DataFrame, key: str, shown: str, n: int, name: str) -> DataFrame:
    """(key, name): the first n of each key in order, by a window that keeps n rows a key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(shown))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).groupBy(key).agg(F.array_sort(F.collect_list(shown)).alias(name))


def _matches(rows: DataFrame, rules: list[tuple[str, Column]], value: Column) -> DataFrame:
    """(rule, value) of each rule that a row fulfils: the rules are tested in the row, without a join."""
    hits = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules)))
    return rows.select(F.explode(hits).alias("rule"), value.alias("value"))


def _constants(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def layers(files: DataFrame, min_confidence: float = 0.2) -> DataFrame:
    roots = large_modules(module_members(files))
    of = lambda c: [(k, contains_any(F.col(c), w)) for k, w in LAYERS.items()]
    m, f = _matches(roots, of("root_path"), F.col("root_path")), _matches(files, of("path"), F.col("path"))
    counts = lambda d, n: d.groupBy("rule").agg(F.count(F.lit(1)).alias(n))
    all_rules = _constants(files.sparkSession, [(i, k) for i, k in enumerate(LAYERS)], "pos int, rule string")
    out = all_rules.join(counts(m, "n_modules"), "rule", "left").join(counts(f, "n_files"), "rule", "left").fillna(0, ["n_modules", "n_files"])
    confidence = F.least((F.col("n_modules") + F.col("n_files") / 10) / 5, F.lit(1.0))
    out = out.withColumn("confidence", confidence).filter(F.col("confidence") > min_confidence)
    out = out.join(_first(f, "rule", "value", SHOWN_FILES, "related_files"), "rule", "left").join(_first(m, "rule", "value", 3, "evidence"), "rule", "left")
    text = F.concat(F.lit("Detected "), "n_modules", F.lit(" modules and "), "n_files", F.lit(" files matching "), F.lower("rule"), F.lit(" patterns."))
    return _concept(out, F.concat(F.lit("layer-"), "rule"), F.col("rule"), "layer", text, round2(F.col("confidence")), 0)


def patterns(files: DataFrame) -> DataFrame:
    f = _matches(files, [(k, contains_any(F.col("path"), w)) for k, _, _, w in PATTERNS], F.col("path"))
    counts = f.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    names = _constants(files.sparkSession, [(i, k, n, u) for i, (k, n, u, _) in enumerate(PATTERNS)], "pos int, rule string, title string, usage string")
    first = _first(f, "rule", "value", SHOWN_FILES, "related_files")
    out = names.join(counts, "rule").join(first, "rule").withColumn("evidence", F.slice("related_files", 1, 3))
    text = F.concat("n", F.lit(" files suggest "), "usage", F.lit("."))
    return _concept(out, F.col("rule"), F.col("title"), "pattern", text, F.least(F.col("n") / 3, F.lit(0.9)), 100)


def domains(files: DataFrame) -> DataFrame:
    members = module_members(files)
    roots = large_modules(members)
    both = F.concat_ws("\n", "root_path", module_name(F.col("root_path")))
    m = _matches(roots, [(k, contains_any(both, (k,))) for k in DOMAINS], F.col("root_path"))
    counts = m.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("value")).alias("evidence"))
    related = m.join(members, m["value"] == members["root_path"]).groupBy("rule").agg(F.array_sort(F.collect_list("path")).alias("related_files"))
    order = _constants(files.sparkSession, [(i, k) for i, k in enumerate(DOMAINS)], "pos int, rule string")
    out = order.join(counts, "rule").join(related, "rule", "left")
    label = F.initcap("rule")
    return _concept(out, F.concat(F.lit("domain-"), "rule"), F.concat(label, F.lit(" Domain")), "domain", F.concat("n", F.lit(" modules related to "), label, F.lit(" functionality.")), F.least(F.col("n") / 3, F.lit(0.95)), 200)


def _concept(df: DataFrame, key: Column, name: Column, kind: str, description: Column, confidence: Column, offset: int) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(
        (F.col("pos") + offset).alias("pos"), short_id(key).alias("id"), name.alias("name"), F.lit(kind).alias("type"), F.coalesce("related_files", empty).alias("related_files"),
        description.alias("description"), confidence.cast("double").alias("confidence"), F.coalesce("evidence", empty).alias("evidence"))


def concepts(files: DataFrame) -> DataFrame:
    """Layers, patterns and domains, in order of `pos`."""
    return reduce(DataFrame.unionByName, [layers(files), patterns(files), domains(files)])


def report(mods: list, found: list) -> str:
    """Markdown of module and concept rows (collected: modules are as many as directories, and ten are shown)."""
    lines = ["## Architecture Analysis", "", f"### Module Boundaries ({len(mods)} detected)", ""]
    rounded = lambda x: int(x * 100 + 0.5)
    for m in mods[:10]:
        lines += [f"#### {m.name}", f"- **Path:** {m.root_path}", f"- **Files:** {len(m.files)}", f"- **Cohesion:** {rounded(m.cohesion)}%", f"- **Coupling:** {rounded(m.coupling)}%"]
        lines += [f"- **Sub-modules:** {', '.join(m.sub_modules)}"] * bool(m.sub_modules) + [""]
    if found:
        lines += ["### Architectural Concepts", ""]
        for c in found:
            lines += [f"- **{c.name}** ({c.type}, {rounded(c.confidence)}%)", f"  {c.description}", ""]
    return "\n".join(lines) + ("" if lines[-1] == "" else "\n")

