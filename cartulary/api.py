"""The engine's facade: index a repository and ask it questions."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartulary.functions.text import expand_query_py, intent_py, normalize_query_py
from cartulary.operators import architecture, conventions, graph, graph_export, index, parsing, search
from cartulary.operators.embedding import Model, hashing_model
from cartulary.operators.store import Store
from cartulary.sources import git
from cartulary.sources.repository import read_repository
from cartulary.streaming import watch


@dataclass
class Section:
    title: str
    content: str
    source_files: list[str]
    relevance: float


@dataclass
class Context:
    id: str
    summary: str
    sections: list[Section]
    token_cost: int
    intent: str
    entities: list[str]
    confidence: float

    def as_dict(self) -> dict:
        return {
            "id": self.id, "summary": self.summary, "tokenCost": self.token_cost,
            "sections": [{"title": s.title, "content": s.content, "sourceFiles": s.source_files, "relevanceScore": s.relevance} for s in self.sections],
            "queryMetadata": {"interpretedIntent": self.intent, "entitiesFound": self.entities, "confidence": self.confidence},
        }


@dataclass
class Engine:
    """One repository (root) and its index (store_path, by default root/.cartulary)."""

    spark: SparkSession
    root: str
    store_path: str | None = None
    model: Model = hashing_model
    store: Store = field(init=False)
    _watching: StreamingQuery | None = field(default=None, init=False)

    def __post_init__(self):
        self.store = Store(self.spark, self.store_path or f"{self.root}/.cartulary")

    # --- indexing

    def index(self, semantic: bool = False, trees: bool = False, purge: bool = True) -> dict[str, int]:
        """Brings the index to the state of the repository; counts by status. semantic: vectors too. trees: syntax trees where a grammar is at hand."""
        registry = parsing.tree_registry() if trees else None
        return index.index(self.store, read_repository(self.spark, self.root), purge, registry=registry, model=self.model if semantic else None)

    def watch(self, checkpoint: str, semantic: bool = False) -> StreamingQuery:
        """Applies changes of the repository as they come, until close()."""
        self._watching = watch.apply_changes(watch.changes(self.spark, self.root), self.store, checkpoint, model=self.model if semantic else None)
        return self._watching

    def close(self) -> None:
        if self._watching is not None:
            self._watching.stop()
            self._watching = None

    # --- retrieval

    def get_context(self, query: str, max_tokens: int = 4000, semantic: bool = True, rank: str = "score", summary: bool = True) -> Context:
        tables = self.store.tables()
        vector = self.model([query])[0] if semantic and self.store.has_embeddings() else None
        text = expand_query_py(normalize_query_py(query))
        searched = {t: self.store.searched(t, text) for t in ("functions", "files")}
        nearest = None if vector is None else self.store.vector_top_k(vector, 8)
        rows, ranked = search.find_context(tables, query, max_tokens, vector, rank, searched, nearest)
        found = rows.orderBy("pos").collect()  # four sections at most
        functions = ranked.orderBy("pos").select("full_name").collect()
        files = search.search_files(searched["files"], text, 10).select("path").collect()
        sections = [Section(r.title, r.content, list(r.source_files), r.relevance) for r in found if r.kept]
        entities = list(dict.fromkeys([f.full_name for f in functions] + [f.path for f in files]))
        return Context(str(uuid.uuid4()), self._summary(query, sections, [f.full_name for f in functions]) if summary else "", sections, sum(r.tokens for r in found), intent_py(query), entities, min(len(sections) / 3, 1.0))

    @staticmethod
    def _summary(query: str, sections: list[Section], functions: list[str]) -> str:
        if not sections:
            return f'No context found for "{query}". Try other words, or index the repository first.'
        files = len({f for s in sections for f in s.source_files})
        key = f"**Key functions:** {', '.join(functions[:3])}\n" if functions else ""
        return f'## Context Summary for: "{query}"\n\nFound {len(sections)} relevant sections across {files} files.\n\n{key}'

    def find_related(self, query: str, max_tokens: int = 4000) -> Context:
        return self.get_context(query, max_tokens, summary=False)

    def get_file_context(self, path: str) -> Section | None:
        r = search.file_context(self.store.tables(), path).first()
        return None if r is None else Section(r.title, r.content, list(r.source_files), r.relevance)

    def record_feedback(self, context_id: str, rating: int, query: str = "", accepted: list[str] | None = None, rejected: list[str] | None = None) -> str:
        key = str(uuid.uuid4())
        row = (key, query, context_id, rating, accepted or [], rejected or [], datetime.now(timezone.utc).replace(tzinfo=None))
        self.store.insert_feedback(self.spark.createDataFrame([row], "id string, query string, context_id string, rating int, accepted_items array<string>, rejected_items array<string>, created_at timestamp"))
        return key

    def stats(self) -> dict[str, int]:
        return {r.entity: r.n for r in self.store.stats().collect()}

    # --- analytics

    def conventions(self, category: str | None = None) -> DataFrame:
        found = conventions.detect(self.store.table("functions"), self.store.table("files"))
        return found if category is None else found.filter(F.col("category") == category)

    def convention_summary(self) -> str:
        rows = self.conventions().orderBy("pos").collect()
        high = [r for r in rows if r.confidence > 0.7]
        lines = [f"Detected {len(rows)} conventions in {len({r.category for r in rows})} categories ({len(high)} of high confidence).", ""]
        for c in dict.fromkeys(r.category for r in rows):
            lines += [f"- {c}: {sum(r.category == c for r in rows)}"]
        return "\n".join(lines)

    def modules(self) -> DataFrame:
        return architecture.modules(self.store.table("files"), self.store.table("functions"), self.store.table("relationships"))

    def concepts(self) -> DataFrame:
        return architecture.concepts(self.store.table("files"))

    def architecture_report(self) -> str:
        return architecture.report(self.modules().orderBy("root_path").collect(), self.concepts().orderBy("pos").collect())

    def graph(self, parity: bool = False, properties: bool = True) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges)."""
        tables = self.store.tables()
        return graph.nodes(tables, properties=properties), graph.edges(tables, graph.node_ids(tables), parity)

    def clusters(self, min_size: int = 3) -> DataFrame:
        return graph.clusters(*self.graph(), min_size)

    def neighbours(self, node: str, depth: int = 1) -> DataFrame:
        return graph.neighbours(self.graph()[1], node, depth)

    def find_path(self, source: str, target: str) -> list[str] | None:
        return graph.shortest_path(self.graph()[1], source, target)

    def graph_stats(self) -> dict:
        rows = graph.stats(*self.graph(properties=False))
        found = rows.collect()  # a row for each type
        by = lambda kind: {r.type: r.n for r in found if r.kind == kind and r.type is not None}
        total = {r.kind: r.n for r in found if r.type is None}
        n, e = total.get("node", 0), total.get("edge", 0)
        return {"nodeCount": n, "edgeCount": e, "nodeTypeBreakdown": by("node"), "edgeTypeBreakdown": by("edge"), "averageDegree": int(2 * e / n * 100 + 0.5) / 100 if n else 0}

    def graph_dot(self) -> str:
        return graph.to_dot(*self.graph())

    def graph_json(self) -> str:
        return graph.to_json(*self.graph())

    def write_graph(self, path: str, kind: str = "json") -> None:
        """The graph as one JSON or DOT file, on any file system and of any size."""
        (graph_export.write_json if kind == "json" else graph_export.write_dot)(*self.graph(), path)

    # --- changes

    def recent_changes(self, days: int = 7, count: int = 10, since: str | None = None) -> dict:
        """Commits, changed files and what is indexed of the first five that are."""
        log = git.commits(self.spark, self.root, days, count, since).orderBy("pos").collect()
        changed = git.changed_files(self.spark, self.root, count)
        names = [r.path for r in changed.orderBy("pos").collect()]
        first = changed.orderBy("pos").limit(10)
        known = self.store.table("files").join(F.broadcast(first), "path").orderBy("pos").limit(5)
        detail = [{"path": r.path, "functions": r.functions} for r in known.join(self.store.table("functions").groupBy("file_id").agg(F.count(F.lit(1)).alias("functions")), known["id"] == F.col("file_id"), "left").select("path", "pos", F.coalesce("functions", F.lit(0)).alias("functions")).orderBy("pos").collect()]
        return {"commits": [(r.hash, r.subject) for r in log], "files": names, "stat": git.diff_stat(self.root, count), "indexed": detail}

    def as_json(self, df: DataFrame) -> str:
        return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2, default=str, ensure_ascii=False)
