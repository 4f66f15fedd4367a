"""Ignore files: patterns to regular expressions, tested on columns or strings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: no blank lines, comments or negations."""
    return [x for line in text.split("\n") if (x := line.strip()) and not x.startswith(("#", "!"))]


def glob_regex(glob: str) -> str:
    """** is anything, * and ? anything but a slash; all else is itself."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in parts)


def pattern_regex(pattern: str) -> str:
    """One regular expression for whole relative paths.

    A pattern without a slash (but at its end) may match any segment; others start at the root, and one that ends in a slash
    also matches what lies below.
    """
    is_dir = pattern.endswith("/")
    glob = pattern[:-1] if is_dir else pattern
    body = glob_regex(glob)
    if "/" not in glob:
        return f"(?:.*/)?(?:{body})(?:/.*)?"
    return f"(?:{body})(?:/.*)?" if is_dir else f"(?:{body})"


def ignored(path: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, (path.rlike(rf"(?s)\A(?:{pattern_regex(p)})\z") for p in patterns))


def ignored_py(path: str, patterns: list[str]) -> bool:
    return any(re.fullmatch(pattern_regex(p), path, re.DOTALL) for p in patterns)
