"""Convention detection: one wide aggregate over functions, one over files, and a rule table on top.

Each rule is a row (key, category, name, pattern, fires, confidence, examples, description, suggestion) made from the aggregates;
the report is the union of those that fire. Examples are the first few in table order, found with bounded arrays: the least k of
each task, merged, so no task gathers all names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import is_camel, is_pascal, is_snake, percent, round2, short_id
from cartulary.operators.ordinals import middle

# Fixed values in the rules below: keys, names, patterns, thresholds, descriptions and suggestions.
COLUMNS = ("id", "category", "name", "pattern", "confidence", "examples", "description", "suggestion")


@dataclass(frozen=True)
class Group:
    """Rows that a rule is about: how many, and the first of them."""

    name: str
    condition: Column
    shown: Column
    order: Column


def _counted(df: DataFrame, groups: list[Group], first: int = 5, *more: DataFrame) -> DataFrame:
    """One row: total, n_<group>, x_<group> (the first names in order), and the columns of `more` (frames of one row).

    Counts are partial sums. The first names come from one more pass, in which Spark keeps `first` rows a group in each task
    before the shuffle (a limit on row_number).
    """
    counts = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(g.condition, F.lit(False))).alias(f"n_{g.name}") for g in groups))
    of = F.array_compact(F.array(*(F.when(g.condition, F.struct(F.lit(g.name).alias("g"), g.order.alias("o"), g.shown.alias("s"))) for g in groups)))
    hits = df.select(F.explode(of).alias("h")).select("h.*")
    top = hits.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("o", "s"))).filter(F.col("r") <= first)
    shown = top.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]).alias("x"))
    shown = shown.agg(F.map_from_entries(F.collect_list(F.struct("g", "x"))).alias("shown"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [shown, *more], counts)
    one = rows.agg(*(F.first(c, ignorenulls=True).alias(c) for c in rows.columns))
    return one.withColumns({f"x_{g.name}": F.coalesce(F.try_element_at("shown", F.lit(g.name)), F.array().cast("array<string>")) for g in groups}).drop("shown")


def function_groups() -> list[Group]:
    name, exported = F.col("name"), F.col("is_exported")
    order = F.struct("file_id", "start_line", "id")
    return [Group(k, c, F.col("full_name"), order) for k, c in (("camel", is_camel(name)), ("pascal", is_pascal(name)), ("snake", is_snake(name)), ("exported", exported), ("exported_camel", exported & is_camel(name)), ("exported_pascal", exported & is_pascal(name)))]


def file_groups() -> list[Group]:
    p = F.col("path")
    ends = lambda *x: reduce(lambda a, b: a | b, (p.endswith(e) for e in x))
    test, inside = F.col("is_test"), p.contains("__tests__/")
    conditions = {
        "barrel": ends("/index.ts", "/index.tsx"), "src": p.startswith("src/"), "packages": p.startswith("packages/"), "tests_dir": inside,
        "test": test, "dot_test": test & ends(".test.ts", ".test.tsx"), "dot_spec": test & ends(".spec.ts", ".spec.tsx"), "colocated": test & ~inside,
        "docs": p.startswith("docs/") | (p == "docs"), "scripts": p.startswith("scripts/") | (p == "scripts"), "pnpm": p == "pnpm-lock.yaml", "turbo": p == "turbo.json",
    }
    return [Group(k, c, p, p) for k, c in conditions.items()]


def _rule(key: str, name: str, pattern: str | Column, fires: Column, confidence: Column | float, examples: Column, description: Column | str, suggestion: Column | str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string") if x is None or isinstance(x, str) else F.lit(float(x))
    return F.struct(
        short_id(F.lit(key)).alias("id"), F.lit(key.split(":")[0]).alias("category"), F.lit(name).alias("name"), lit(pattern).alias("pattern"), lit(confidence).cast("double").alias("confidence"),
        examples.alias("examples"), lit(description).alias("description"), lit(suggestion).alias("suggestion"), F.coalesce(fires, F.lit(False)).alias("fires"), F.lit(key).alias("key"))


def _n(name: str) -> Column:
    return F.col(f"n_{name}")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _fired(counts: DataFrame, rules: list[Column]) -> DataFrame:
    rows = counts.select(F.posexplode(F.array(*rules)).alias("pos", "r")).filter("r.fires")
    return rows.select("pos", *(F.col(f"r.{c}") for c in COLUMNS))


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def naming(functions: DataFrame) -> DataFrame:
    total = F.greatest(F.col("total"), F.lit(1))
    share = {k: _ratio(_n(k), total) for k in ("camel", "pascal", "snake")}
    of_exported = {k: _ratio(_n(f"exported_{k}"), F.greatest(_n("exported"), F.lit(1))) for k in ("camel", "pascal")}
    return _fired(_counted(functions, function_groups()), [
        _rule("naming:camelCase-functions", "camelCase function names", "^[a-z][a-zA-Z0-9]*$", share["camel"] > 0.3, round2(share["camel"]), F.col("x_camel"), _text(_n("camel"), " of ", total, " functions use camelCase naming"), "Continue using camelCase for functions and variables."),
        _rule("naming:pascalCase-functions", "PascalCase function names", "^[A-Z][a-zA-Z0-9]*$", share["pascal"] > 0.2, round2(share["pascal"]), F.col("x_pascal"), _text(_n("pascal"), " functions use PascalCase (likely React components or classes)"), "PascalCase is idiomatic for React components and class constructors."),
        _rule("naming:snake_case-functions", "snake_case function names", "^[a-z][a-z0-9]*(_[a-z0-9]+)*$", share["snake"] > 0.3, round2(share["snake"]), F.col("x_snake"), _text(_n("snake"), " functions use snake_case naming"), "Consider camelCase for consistency if this is a TypeScript codebase."),
        _rule("naming:exported-camelCase", "Exported functions use camelCase", "Exported functions: camelCase", of_exported["camel"] > 0.5, round2(of_exported["camel"]), F.col("x_exported_camel"), _text(_n("exported_camel"), " of ", _n("exported"), " exported functions use camelCase")),
        _rule("naming:exported-pascalCase", "Exported functions use PascalCase", "Exported functions: PascalCase", of_exported["pascal"] > 0.5, round2(of_exported["pascal"]), F.col("x_exported_pascal"), _text(_n("exported_pascal"), " of ", _n("exported"), " exported functions use PascalCase")),
    ])


def _file_rules(files: DataFrame, rules: list[Column], groups: list[str]) -> DataFrame:
    return _fired(_counted(files, [g for g in file_groups() if g.name in groups]), rules)


def _scaled(name: str, by: int) -> Column:
    return F.least(_n(name) / by, F.lit(1.0))


def file_structure(files: DataFrame) -> DataFrame:
    src = _ratio(_n("src"), F.col("total"))
    at_middle = middle(files.filter(F.col("path").startswith("src/")), "path")
    at_middle = files.sparkSession.createDataFrame([(at_middle,)], "x_middle string")
    counted = _counted(files, [g for g in file_groups() if g.name in ("barrel", "src", "packages", "tests_dir")], 5, at_middle)
    return _fired(counted, [
        _rule("file-structure:barrel-files", "Barrel export files (index.ts)", "**/index.ts", _n("barrel") > 2, _scaled("barrel", 10), F.col("x_barrel"), _text(_n("barrel"), " barrel files found. Common pattern for re-exporting modules."), "Barrel files help keep imports clean but can cause circular dependency issues."),
        _rule("file-structure:src-directory", "Source code in src/ directory", "src/**", src > 0.5, round2(src), F.array_compact(F.array(F.get("x_src", F.lit(0)), F.col("x_middle"))), _text(_n("src"), " of ", F.col("total"), " files are under src/")),
        _rule("file-structure:monorepo-packages", "Monorepo package structure", "packages/*/src/**", _n("packages") > 0, _scaled("packages", 20), F.col("x_packages"), _text(_n("packages"), " files in a monorepo packages/ structure"), "Monorepos benefit from shared conventions across packages."),
        _rule("file-structure:tests-directory", "Tests in __tests__ directories", "**/__tests__/*", _n("tests_dir") > 0, _scaled("tests_dir", 5), F.col("x_tests_dir"), _text(_n("tests_dir"), " test files in __tests__/ directories")),
    ])


def testing(files: DataFrame) -> DataFrame:
    some, none = _n("test") > 0, F.array().cast("array<string>")
    of_tests = lambda k: _ratio(_n(k), _n("test"))
    total = F.greatest(F.col("total"), F.lit(1))
    share = percent(_n("test") / total)
    return _file_rules(files, [
        _rule("testing:no-tests", "No test files detected", "N/A", ~some, 1.0, none, "No test files found in the codebase.", "Consider adding tests for critical functionality."),
        _rule("testing:test-suffix", "Test files use .test.ts suffix", "*.test.ts", some & (of_tests("dot_test") > 0.5), round2(of_tests("dot_test")), F.col("x_dot_test"), _text(_n("dot_test"), " of ", _n("test"), " test files use .test.ts naming (Vitest/Jest convention)")),
        _rule("testing:spec-suffix", "Test files use .spec.ts suffix", "*.spec.ts", some & (of_tests("dot_spec") > 0.5), round2(of_tests("dot_spec")), F.col("x_dot_spec"), _text(_n("dot_spec"), " of ", _n("test"), " test files use .spec.ts naming")),
        _rule("testing:test-coverage-ratio", "Test file ratio", _text(_n("test"), " test files / ", total, " total files"), some, 1.0, none, _text(share, "% of files are test files (", _n("test"), " of ", total, ")"), F.when(share < 15, "Test coverage appears low. Consider adding more tests.")),
        _rule("testing:colocated-tests", "Co-located test files", "Tests next to source files", some & (of_tests("colocated") > 0.5), round2(of_tests("colocated")), F.col("x_colocated"), _text(_n("colocated"), " test files are co-located with source files")),
    ], ["test", "dot_test", "dot_spec", "colocated"])


def exports(functions: DataFrame, files: DataFrame) -> DataFrame:
    total = F.col("total")
    ratio = _fired(_counted(functions, [g for g in function_groups() if g.name == "exported"]), [
        _rule("exports:export-ratio", "Export visibility", _text(_n("exported"), " exported / ", total, " total functions"), _n("exported") > 0, 1.0, F.col("x_exported"), _text(percent(_n("exported") / F.greatest(total, F.lit(1))), "% of functions are exported")),
    ])
    barrels = _file_rules(files, [
        _rule("exports:barrel-exports", "Barrel export pattern", "index.ts re-exports", _n("barrel") > 0, _scaled("barrel", 5), F.col("x_barrel"), _text(_n("barrel"), " barrel index files found"), "Named exports are preferred over barrel re-exports for tree-shaking."),
    ], ["barrel"])
    return ratio.unionByName(barrels.withColumn("pos", F.col("pos") + 1))


def directories(files: DataFrame) -> DataFrame:
    return _file_rules(files, [
        _rule("directory:docs-directory", "Documentation in docs/", "docs/ directory", _n("docs") > 0, 0.9, F.slice("x_docs", 1, 3), "Project has a dedicated docs/ directory for documentation"),
        _rule("directory:scripts-directory", "Build/tool scripts in scripts/", "scripts/ directory", _n("scripts") > 0, 0.9, F.slice("x_scripts", 1, 3), "Project has a scripts/ directory for build and tool scripts"),
        _rule("directory:pnpm-package-manager", "pnpm package manager", "pnpm-lock.yaml", _n("pnpm") > 0, 1.0, F.slice("x_pnpm", 1, 1), "Project uses pnpm as the package manager"),
        _rule("directory:turborepo", "Turborepo monorepo", "turbo.json", _n("turbo") > 0, 1.0, F.slice("x_turbo", 1, 1), "Project uses Turborepo for monorepo orchestration"),
    ], ["docs", "scripts", "pnpm", "turbo"])


def top_directories(files: DataFrame) -> DataFrame:
    """Files by first path segment."""
    return files.groupBy(F.split("path", "/")[0].alias("directory")).agg(F.count(F.lit(1)).alias("files"))


def detect(functions: DataFrame, files: DataFrame) -> DataFrame:
    """All conventions that hold, in order of `pos`."""
    parts = [naming(functions), file_structure(files), testing(files), exports(functions, files), directories(files)]
    return reduce(DataFrame.unionByName, (p.withColumn("pos", F.col("pos") + 100 * i) for i, p in enumerate(parts)))


def file_counts(conventions: DataFrame) -> DataFrame:
    """Examples and conventions by category, and how many are of high confidence."""
    return conventions.groupBy("category").agg(F.sum(F.size("examples")).alias("examples"), F.count(F.lit(1)).alias("conventions"), F.count_if(F.col("confidence") > 0.7).alias("high_confidence"))
