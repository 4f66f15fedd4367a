"""The snapshot store: entity tables as versioned Parquet folders, changed by anti-join and union.

A table is cut into buckets by a hash of the file that a row belongs to, so all that a file owns is in one bucket of each table. A
change writes the buckets that it touches beside the old ones, and then a manifest that names a folder for each bucket. Manifests
are never changed or written over: each has the next number, a reader takes the highest, and so sees the old state or the new one
whole. Of two writers at the same time one fails. Buckets are sorted by file, which gives Parquet's statistics for point lookups.

With functions and files a change writes posting lists of their grams (see gram_index), bucket by bucket, and with relationships the
same rows in buckets by their targets, so both ends of an edge are found in one bucket each.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.functions.text import keywords_py
from cartulary.operators import gram_index, search, vector_index
from cartulary.schema import DERIVED, KEYS, SCHEMA_VERSION, TABLES, checked, with_defaults
from cartulary.scratch import scratch
from cartulary.scratch import written as written_table

CHILDREN = ("functions", "classes", "types")
#: The column that tells the file (or another thing with a prefix of its own) that a row belongs to.
OWNER = {"files": "id", "functions": "file_id", "classes": "file_id", "types": "file_id", "relationships": "source_id", "relationships_in": "target_id", "imports": "from_path", "embeddings": "entity_id", "feedback": "id"}
#: Manifests, beside the newest, whose data stay.
KEPT = 10


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, n) of each table."""
    return reduce(DataFrame.union, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("entity"), "n") for k, df in tables.items()))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order; partial maxima before the shuffle."""
    value = F.struct(order, *(c for c in rows.columns if c != order))
    last = rows.groupBy(*key).agg(F.max(value).alias("_v")) if all(not t.startswith("map") for _, t in rows.dtypes) else None
    if last is None:  # maps have no order
        w = Window.partitionBy(*key).orderBy(F.col(order).desc())
        return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return last.select(*(F.col(f"_v.{c}").alias(c) if c not in key else F.col(c) for c in rows.columns))


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the keys of new replaced by new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def diff(scanned: DataFrame, indexed: DataFrame, deleted: bool = False) -> DataFrame:
    """scanned and indexed (path, content_hash): path and status new, changed or unchanged; with deleted also deleted."""
    s, i = scanned.select("path", F.col("content_hash").alias("now")), indexed.select("path", F.col("content_hash").alias("before"))
    both = s.join(i, "path", "full_outer" if deleted else "left")
    return both.select("path", F.when(F.col("now").isNull(), "deleted").when(F.col("before").isNull(), "new").when(F.col("before") != F.col("now"), "changed").otherwise("unchanged").alias("status"))


def progress(changes: DataFrame) -> DataFrame:
    """(status, n)."""
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """tables without the files in gone (id) and all that belongs to them: functions, classes, types, relationships and vectors."""
    out = dict(tables)
    file_id = gone.select(F.col("id").alias("file_id")).distinct()
    owned = [gone.select("id")]
    for t in CHILDREN:
        if t in tables:
            owned.append(tables[t].join(file_id, "file_id", "left_semi").select("id"))
            out[t] = tables[t].join(file_id, "file_id", "left_anti").select(tables[t].columns)
    ids = reduce(DataFrame.union, owned).distinct()
    if "files" in tables:
        out["files"] = tables["files"].join(gone.select("id").distinct(), "id", "left_anti").select(tables["files"].columns)
    if "imports" in tables:
        out["imports"] = tables["imports"].join(gone.select(F.col("id").alias("from_path")).distinct(), "from_path", "left_anti").select(tables["imports"].columns)
    if "embeddings" in tables:
        out["embeddings"] = tables["embeddings"].join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(tables["embeddings"].columns)
    if "relationships" in tables:  # what leaves a file goes with it; what points to it is resolved again
        out["relationships"] = tables["relationships"].join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(tables["relationships"].columns)
    return out


def relationships_of(relationships: DataFrame, entity: str) -> DataFrame:
    """Relationships that start or end at an entity; one that does both is listed once."""
    starts = relationships.filter(F.col("source_id") == entity)
    return starts.union(relationships.filter((F.col("target_id") == entity) & ~F.col("source_id").eqNullSafe(F.lit(entity))))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """(context_id, n, rating, rejected, last): of each context how often it was rated, the mean rating, how often something was rejected, and when last."""
    rejected = F.count_if(F.size(F.coalesce("rejected_items", F.array().cast("array<string>"))) > 0)
    return feedback.groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("rating"), rejected.alias("rejected"), F.max("created_at").alias("last"))


def bucket_of(owner: Column, buckets: int) -> Column:
    """The bucket of a file's path, or of an id that starts with it and a colon."""
    return F.pmod(F.xxhash64(F.substring_index(owner, ":", 1)), F.lit(buckets)).cast("int")


class Store:
    """Entity tables under a folder: <root>/data/<table>/<change>/bucket=<n>, and manifests <root>/versions/<number>.

    buckets counts when the store is made; later the first manifest tells it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._buckets = spark, root, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *filter(None, parts))))

    # --- manifests

    def versions(self) -> list[int]:
        """Numbers of the manifests, ascending."""
        place = self._path("versions")
        if not self._fs.exists(place):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(place))
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (by default the newest) consists of; an empty one without a store, or for another schema version."""
        if version is None:
            version = max(self.versions(), default=None)
        empty = {"schema": SCHEMA_VERSION, "version": version or 0, "buckets": self._buckets, "tables": {}}
        if version is None:
            return empty
        stream = self._fs.open(self._path("versions", str(version)))
        try:
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return found if found["schema"] == SCHEMA_VERSION else empty

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest under a name of its own and gives it its number, unless there is one with that number."""
        draft = self._path("versions", f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path("versions", str(manifest["version"])), never_over)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer made version {manifest['version']}") from e

    def vacuum(self, kept: int = KEPT) -> None:
        """Deletes all but the newest manifest and `kept` before it, and the data that none of these name."""
        versions = self.versions()
        live = versions[-kept - 1 :]
        used = {(t, change) for v in live for t, places in self.manifest(v)["tables"].items() for change in places.values()}
        for version in versions[: -kept - 1]:
            for t, places in self.manifest(version)["tables"].items():
                for change in set(places.values()):
                    if (t, change) not in used:
                        self._fs.delete(self._path("data", t, change), True)
            self._fs.delete(self._path("versions", str(version)), False)
        self._sweep(live)

    def _sweep(self, live: list[int]) -> None:
        """Deletes data that no manifest names, of writers that failed or came second. Data newer than the oldest manifest may be a writer's that is at work, and stay."""
        if not live or not self._fs.exists(self._path("data")):
            return
        since = self._fs.getFileStatus(self._path("versions", str(live[0]))).getModificationTime()
        named = {(t, change) for v in live for t, places in self.manifest(v)["tables"].items() for change in places.values()}
        for table in self._fs.listStatus(self._path("data")):
            for x in self._fs.listStatus(table.getPath()):
                if (table.getPath().getName(), x.getPath().getName()) not in named and x.getModificationTime() < since:
                    self._fs.delete(x.getPath(), True)

    # --- tables

    @property
    def is_indexed(self) -> bool:
        return bool(self.manifest()["tables"])

    def buckets(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets that rows of a table go to."""
        found = rows.select(bucket_of(F.col(OWNER[table]), self.manifest()["buckets"]).alias("b")).distinct().collect()  # as many as there are buckets
        return sorted(r.b for r in found)

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        return self._table(self.manifest(), name, buckets)

    def _table(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        places = manifest["tables"].get(name, {})
        wanted = sorted(places) if buckets is None else [str(b) for b in buckets if str(b) in places]
        if not wanted:
            return self.spark.createDataFrame([], (TABLES | DERIVED)[name])
        return self.spark.read.schema((TABLES | DERIVED)[name]).parquet(*(f"{self.root}/data/{name}/{places[b]}/bucket={b}" for b in wanted))

    def tables(self, buckets: list[int] | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        manifest = self.manifest()
        return {t: self._table(manifest, t, buckets) for t in TABLES}

    def write(self, changed: dict[str, DataFrame], buckets: dict[str, list[int]] | None = None) -> None:
        """A new version, in which some tables (or the given buckets of them) have these rows and all else stays."""
        manifest = self.manifest()
        tables, change, before = manifest["tables"], uuid.uuid4().hex, json.loads(json.dumps(manifest))

        def put(name: str, rows: DataFrame, *by: str, dealt: bool = False) -> set[str]:
            """Writes rows (with bucket) of a table; the buckets that have some. dealt: they are in tasks by bucket already."""
            (rows if dealt else rows.hint("rebalance", "bucket")).sortWithinPartitions("bucket", *by).write.partitionBy("bucket", *by[:-1]).parquet(f"{self.root}/data/{name}/{change}")
            return {x.getPath().getName().removeprefix("bucket=") for x in self._fs.listStatus(self._path("data", name, change)) if x.isDirectory()}

        def made(name: str) -> set[str]:
            rows = checked(name, with_defaults(name, changed[name])).withColumn("bucket", bucket_of(F.col(OWNER[name]), manifest["buckets"]))
            return put(name, rows, OWNER[name])

        def replaced(name: str, places: set[str], touched: set[str]) -> None:
            tables[name] = {b: c for b, c in tables.get(name, {}).items() if b not in touched} | dict.fromkeys(places, change)

        def derived(name: str) -> tuple[str, set[str], set[str]]:
            """What is derived from a table that has been written: its name, the buckets that have rows, and those that are replaced."""
            rows = self._table({"tables": {name: dict.fromkeys(written[name], change)}}, name)
            if name in gram_index.SOURCES:
                index, fields = gram_index.SOURCES[name]
                rows = rows.withColumn("bucket", bucket_of(F.col(OWNER[name]), manifest["buckets"]))
                return index, put(index, gram_index.postings(rows, fields, len(written[name])), "part", "gram", dealt=True), gone[name]
            target = bucket_of(F.col("target_id"), manifest["buckets"])
            old = self._table(before, name, sorted(map(int, gone[name])))
            touched = sorted(r.b for r in rows.union(old).select(target.alias("b")).distinct().collect())  # as many as there are buckets
            stay = self._table(before, "relationships_in", touched).filter(~bucket_of(F.col("source_id"), manifest["buckets"]).isin(sorted(map(int, gone[name]))))
            return "relationships_in", put("relationships_in", stay.union(rows).withColumn("bucket", target), "target_id"), set(map(str, touched))

        with ThreadPoolExecutor(len(changed) or 1) as pool:  # the tables are written side by side
            written = dict(zip(changed, pool.map(made, changed), strict=True))
            gone = {}
            for name, places in written.items():
                gone[name] = {str(b) for b in buckets[name]} if buckets is not None and name in buckets else {*tables.get(name, {}), *places}
                if not places <= gone[name]:
                    raise ValueError(f"rows of {name} are outside the buckets that are replaced")
                replaced(name, places, gone[name])
            for name, places, touched in pool.map(derived, [t for t in changed if t in gram_index.SOURCES or t == "relationships"]):
                replaced(name, places, touched)
        self._publish(manifest | {"version": manifest["version"] + 1})
        self.vacuum()

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows replace those with their key; of several with one key any may win, so give latest() its order first."""
        key = KEYS[table]
        new = with_defaults(table, rows).dropDuplicates(key)
        old = self.table(table).join(new.select(*key), key, "left_semi")
        touched = sorted({*self.buckets(table, new), *self.buckets(table, old)})
        self.write({table: merged(self.table(table, touched), new, key)}, {table: touched})

    def insert_feedback(self, rows: DataFrame) -> None:
        """Appends; an id that is there already is an error."""
        touched = self.buckets("feedback", rows)
        old = self.table("feedback", touched)
        twice = rows.join(old.select("id"), "id", "left_semi")
        if not twice.isEmpty():
            raise ValueError("feedback has an id that exists")
        self.write({"feedback": old.unionByName(with_defaults("feedback", rows))}, {"feedback": touched})

    def delete_files(self, gone: DataFrame) -> None:
        """Deletes files (id) with all that belongs to them."""
        touched = self.buckets("files", gone)
        before = self.tables(touched)
        after = {t: df for t, df in without_files(before, gone).items() if df is not before[t]}
        self.write(after, dict.fromkeys(after, touched))

    def delete_embeddings(self, gone: DataFrame) -> None:
        """Deletes the vectors of files' functions and classes, not the files."""
        touched = self.buckets("files", gone)
        self.write({"embeddings": without_files(self.tables(touched), gone)["embeddings"]}, {"embeddings": touched})

    # --- lookups

    def file_by_path(self, path: str) -> DataFrame:
        return self._of(path, "files").filter(F.col("path") == path)

    def function_by_id(self, key: str) -> DataFrame:
        return self._of(key, "functions").filter(F.col("id") == key)

    def _of(self, owner: str, table: str) -> DataFrame:
        """The bucket that an owner's rows are in."""
        n = self.manifest()["buckets"]
        return self.table(table, [self.spark.range(1).select(bucket_of(F.lit(owner), n)).first()[0]])

    def relationships_of(self, entity: str) -> DataFrame:
        """Relationships that start or end at an entity, each once; reads a bucket of each projection."""
        ends = self._of(entity, "relationships_in").filter((F.col("target_id") == entity) & ~F.col("source_id").eqNullSafe(F.lit(entity)))
        return self._of(entity, "relationships").filter(F.col("source_id") == entity).union(ends)

    def neighbours(self, start: str, depth: int = 1) -> DataFrame:
        """(id, distance, edge_id) of what relationships reach from start within depth steps, either way; start excluded.

        Each round reads the buckets of its frontier only. edge_id: the least edge that leads there from the round before."""
        manifest = self.manifest()
        with scratch():
            seen = frontier = self.spark.createDataFrame([(start, 0, None)], "id string, distance int, edge_id string")
            for d in range(1, depth + 1):
                own = sorted(r.b for r in frontier.select(bucket_of(F.col("id"), manifest["buckets"]).alias("b")).distinct().collect())  # as many as there are buckets
                out, into = (self._table(manifest, t, own) for t in ("relationships", "relationships_in"))
                at = frontier.select(F.col("id").alias("at"))
                steps = out.join(at, F.col("source_id") == F.col("at")).select(F.col("target_id").alias("to"), "id").union(into.join(at, F.col("target_id") == F.col("at")).select(F.col("source_id").alias("to"), "id"))
                step = steps.groupBy(F.col("to").alias("id")).agg(F.min("id").alias("edge_id")).join(seen.select("id"), "id", "left_anti")
                frontier = written_table(step.select("id", F.lit(d).alias("distance"), "edge_id"), "ring")
                if frontier.isEmpty():
                    break
                seen = seen.union(frontier)
            return written_table(seen.filter("distance > 0"), "neighbours", keep=True)

    def searched(self, name: str, query: str) -> DataFrame:
        """The rows of functions or files that a keyword search for query may find: by the gram index where it helps, else all."""
        manifest = self.manifest()
        index = gram_index.SOURCES[name][0]

        def lists(grams: list[str]) -> DataFrame:
            places = manifest["tables"].get(index, {})
            frames = [
                self.spark.read.schema(f"{DERIVED[index]}, bucket int, part int").option("basePath", f"{self.root}/data/{index}/{change}").parquet(*(f"{self.root}/data/{index}/{change}/bucket={b}" for b in sorted(places) if places[b] == change))
                for change in sorted(set(places.values()))
            ]
            if not frames:
                return self.spark.createDataFrame([], f"{DERIVED[index]}, bucket int, part int")
            parts = [r.p for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(gram_index.part_of(F.col("g")).alias("p")).distinct().collect()]
            return reduce(DataFrame.union, frames).filter(F.col("part").isin(parts) & F.col("gram").isin(grams))

        whole = self._table(manifest, name)
        found = gram_index.candidates(lists, whole.count(), keywords_py(query) or [query])  # counts come from the files' footers
        if found is None:
            return whole
        with scratch():
            found = written_table(found, "candidates", keep=True)
        own = sorted(r.of_bucket for r in found.select("of_bucket").distinct().collect())  # as many as there are buckets
        return self._table(manifest, name, own).join(found.select("id"), "id", "left_semi")

    def build_vector_index(self, lists: int | None = None) -> None:
        """Writes inverted lists of the vectors as a new version; they serve until the vectors change."""
        manifest, change = self.manifest(), uuid.uuid4().hex
        places = manifest["tables"].get("embeddings", {})
        if places:
            vector_index.build(self._table(manifest, "embeddings"), f"{self.root}/data/vector_lists/{change}", lists)
            tables = manifest["tables"] | {"vector_lists": {"all": change}}
            self._publish(manifest | {"version": manifest["version"] + 1, "tables": tables, "vectors_of": places})
            self.vacuum()

    def vector_top_k(self, query: list[float], k: int, entity_type: str | None = "function", probed: float | str | None = vector_index.MEASURED) -> DataFrame:
        """entity_id and score of the best vectors: by the inverted lists if they are of the vectors as they are now, else by a scan. probed: see vector_index.search."""
        manifest = self.manifest()
        lists, places = manifest["tables"].get("vector_lists"), manifest["tables"].get("embeddings", {})
        if not lists or not places or manifest.get("vectors_of") != places:
            return search.vector_top_k(self._table(manifest, "embeddings"), query, k, entity_type)
        return vector_index.search(self.spark, f"{self.root}/data/vector_lists/{lists['all']}", query, k, entity_type, probed)

    def search_functions(self, query: str, limit: int = 20, rank: str = "score") -> DataFrame:
        """search.search_functions over the store, by the gram index."""
        return search.search_functions(self.searched("functions", query), query, limit, rank)

    def search_files(self, query: str, limit: int = 20) -> DataFrame:
        """search.search_files over the store, by the gram index."""
        return search.search_files(self.searched("files", query), query, limit)

    def feedback_for(self, context_id: str) -> DataFrame:
        return self.table("feedback").filter(F.col("context_id") == context_id).orderBy(F.col("created_at").desc(), "id")

    def has_embeddings(self) -> bool:
        return not self.table("embeddings").isEmpty()

    def stats(self) -> DataFrame:
        tables = self.tables()
        return counts({t: tables[t] for t in ("files", *CHILDREN, "relationships")})
