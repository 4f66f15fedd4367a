"""Source trees as a Spark data source: `repository` gives (path, content) of code files, and a stream of changes.

Built-in file sources hide names that start with `_` or `.`, and their streams never tell of deleted files; so this one walks the
tree itself. The driver lists paths; executors read the files, which must lie where they can open them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from cartulary.functions.constants import LANGUAGES, SKIPPED_DIRECTORIES
from cartulary.sources.ignore import ignored_py, read_patterns


def read_text(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        return f.read()


def find_files(root: str, extensions: tuple[str, ...] = tuple(LANGUAGES), use_ignore: bool = True) -> list[str]:
    """Relative paths of the code files below root, without hidden and skipped directories and what the root's ignore file names."""
    ignore = os.path.join(root, ".gitignore")
    patterns = read_patterns(read_text(ignore)) if use_ignore and os.path.isfile(ignore) else []
    found = []
    for folder, folders, names in os.walk(root):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        inside = (lambda x: x) if below == "." else (lambda x, b=below: f"{b}/{x}")
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in SKIPPED_DIRECTORIES and not ignored_py(inside(d), patterns))
        found += [inside(x) for x in sorted(names) if os.path.splitext(x)[1] in extensions and not ignored_py(inside(x), patterns)]
    return found


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.slices = options["path"], int(options.get("slices", "0"))

    def partitions(self) -> list[_Slice]:
        paths = find_files(self.root)
        n = self.slices or max(1, min(len(paths) // 64, 1024))
        return [_Slice(paths[i::n]) for i in range(n)]

    def read(self, partition: _Slice) -> Iterator[tuple[str, str]]:
        for p in partition.paths:
            try:
                yield p, read_text(os.path.join(self.root, p))
            except OSError:  # gone since it was listed
                continue


#: What a watch doesn't look at, anywhere in a relative path (fixed value).
WATCH_IGNORED = re.compile(r"(^|/)\.|node_modules|dist")


class _Changes(SimpleDataSourceStreamReader):
    """Changes since the last offset, which is the map of paths to content hashes.

    A replay gives the same paths; contents are those of the time when it runs, or an unlink if the file is gone, so that applying
    them again leads to the same state. A file counts once it hasn't been written to for `settle` milliseconds; until then it is as
    it was before. Files are hashed when their time or size has changed. The driver lists the tree, which must be where it can.
    """

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.existing = options.get("existing", "true") == "true"
        self.settle = float(options.get("settle", "300")) / 1000
        self.hashes: dict[str, tuple[tuple[int, int], str]] = {}  # path: (time and size), hash

    def _state(self, before: dict[str, str]) -> dict[str, str]:
        # A running watch doesn't read the ignore file; a scan does.
        out = {}
        for p in find_files(self.root, use_ignore=False):
            if WATCH_IGNORED.search(p):
                continue
            try:
                place = os.path.join(self.root, p)
                found = os.stat(place)
                if time.time() - found.st_mtime < self.settle:
                    if p in before:
                        out[p] = before[p]
                    continue
                mark = (found.st_mtime_ns, found.st_size)
                if self.hashes.get(p, (None, ""))[0] != mark:
                    with open(place, "rb") as f:
                        self.hashes[p] = mark, hashlib.sha256(f.read()).hexdigest()
                out[p] = self.hashes[p][1]
            except OSError:
                continue
        return out

    def initialOffset(self) -> dict:
        return {"files": json.dumps({} if self.existing else self._state({}), sort_keys=True)}

    def _between(self, before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str, str | None]]:
        rows = []
        for p in sorted(before.keys() | after.keys()):
            if p not in after:
                rows.append(("unlink", p, None))
            elif before.get(p) != after[p]:
                try:
                    rows.append(("change" if p in before else "add", p, read_text(os.path.join(self.root, p))))
                except OSError:
                    rows.append(("unlink", p, None))
        return rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before = json.loads(start["files"])
        after = self._state(before)
        return iter(self._between(before, after)), {"files": json.dumps(after, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(json.loads(start["files"]), json.loads(end["files"])))


class RepositorySource(DataSource):
    """Options: path (a folder); slices (batch: number of partitions); existing (stream: whether files that are there at the start count as added)."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class RepositoryChanges(DataSource):
    """The stream of a repository's changes: op (add, change, unlink), path, content. Options: path, existing, settle (milliseconds)."""

    @classmethod
    def name(cls) -> str:
        return "repository_changes"

    def schema(self) -> str:
        return "op string, path string, content string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositorySource)
    spark.dataSource.register(RepositoryChanges)


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("repository").option("path", root).load()
