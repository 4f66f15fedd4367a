"""What git tells of a repository, as small DataFrames made on the driver."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

#: What can only be a date (or a span like "2 weeks ago"), not a revision.
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}|\bago\b|^(?:yesterday|today|now)$|^\d+\s*\.?\s*(?:day|week|month|year|hour|minute)", re.I)


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return [x for x in done.stdout.split("\n") if x]


def is_date(since: str) -> bool:
    return bool(_DATE.search(since.strip()))


def clamp(days: int, count: int) -> tuple[int, int]:
    return max(1, min(days, 365)), max(1, min(count, 100))


def commits(spark: SparkSession, root: str, days: int = 7, count: int = 10, since: str | None = None) -> DataFrame:
    """(pos, hash, subject) of the last commits: since a date, after a revision, or of the last days."""
    days, count = clamp(days, count)
    if since is not None and since.lstrip().startswith("-"):
        raise ValueError(f"neither a date nor a revision: {since}")
    span = [f"--since={days} days ago"] if since is None else [f"--since={since}"] if is_date(since) else [f"{since}..HEAD"]
    lines = _git(root, "log", "--oneline", f"-{count}", *span)
    return spark.createDataFrame([(i, *x.partition(" ")[::2]) for i, x in enumerate(lines)], "pos int, hash string, subject string")


def changed_files(spark: SparkSession, root: str, count: int = 10) -> DataFrame:
    """(pos, path) of files changed in the last commits (20 at most, and no more than there are)."""
    back = min(count, 20, int(_git(root, "rev-list", "--count", "HEAD")[0]) - 1)
    names = _git(root, "diff", "--name-only", f"HEAD~{back}..HEAD") if back > 0 else []
    return spark.createDataFrame(list(enumerate(names)), "pos int, path string")


def diff_stat(root: str, count: int = 10, lines: int = 20) -> list[str]:
    """The last lines of the diff's statistics."""
    back = min(count, 20, int(_git(root, "rev-list", "--count", "HEAD")[0]) - 1)
    return _git(root, "diff", "--stat", f"HEAD~{back}..HEAD")[-lines:] if back > 0 else []
