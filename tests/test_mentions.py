"""Mentions against LIKE, with all words in one automaton and in shards."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cartulary.operators import architecture, mentions
from tests.test_operators import files_of, frame, functions_of


def like(word, text):
    return re.search("".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in word), text, re.DOTALL) is not None


def shuffled(plan):
    """Bytes that a finished plan's exchanges wrote."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(plan.plan())
    children = plan.children()
    own = plan.metrics().apply("shuffleBytesWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("seed", range(3))
def test_finder_is_like(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab_%c\\\n") for _ in range(rng.randint(0, n)))
    words = list({text(6) for _ in range(200)})
    finder = mentions.Finder(words)
    for _ in range(300):
        fields = [text(25) for _ in range(3)]
        assert finder.found(fields) == {i for i, w in enumerate(words) if any(like(w, f) for f in fields)}, fields


@pytest.mark.parametrize("shard_chars", [1 << 20, 40])
def test_mentions(spark, monkeypatch, shard_chars):
    monkeypatch.setattr(mentions, "SHARD_CHARS", shard_chars)
    monkeypatch.setattr(mentions, "SLICE_CHARS", 60)
    words = ["load", "lo_d", "a%b", "", "_", "____________________________", "x", "id", "snake_case_name", "back\\slash", "ünï", "load"]
    rows = [
        {"id": "1", "file_id": "f1", "name": "Load", "full_name": "Load", "doc_comment": "uses snakeXcaseYname"}, {"id": "2", "file_id": "f2", "name": "q", "full_name": "q", "doc_comment": "a\nb"},
        {"id": "3", "file_id": "f2", "name": None, "full_name": "ÜNÏ", "doc_comment": "back\\slash"}, {"id": "4", "file_id": "f3", "name": "lo", "full_name": "ad", "doc_comment": None},
    ]
    functions = frame(spark, "functions", rows)
    found = mentions.mentions(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), functions).collect()
    low = [{"file_id": r["file_id"], "fields": [(r[c] or "").lower() for c in mentions.FIELDS]} for r in rows]
    assert len(found) == len({(r.word, r.file_id) for r in found})
    assert {(r.word, r.file_id) for r in found} == {(w, r["file_id"]) for w in words for r in low if any(like(w, f) for f in r["fields"])}
    assert mentions.mentions(spark.createDataFrame([], "word string"), functions).count() == 0
    assert mentions.mentions(spark.createDataFrame([("a",)], "word string"), functions.filter("false")).count() == 0


def test_coupling_with_long_comments(spark):
    """3,000 functions with 20,000 characters of comment each: 60 million characters stream past the names; what is shuffled are names and files."""
    names = spark.range(3000).select(F.concat(F.lit("m"), F.col("id") % 50, F.lit("/sub/f"), F.col("id"), F.lit(".ts")).alias("file_id"), F.concat(F.lit("exported"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), "id")
    comment = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(312)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256)), "")
    functions = names.select(F.col("id").cast("string").alias("id"), "name", F.col("name").alias("full_name"), "file_id", F.concat(comment, F.lit(" exported"), F.lpad(((F.col("id") * 7) % 3000).cast("string"), 5, "0")).alias("doc_comment"), F.lit(True).alias("is_exported"))
    files = names.select(F.col("file_id").alias("id"), F.col("file_id").alias("path"))
    members, exports = architecture.module_members(files), architecture.file_exports(functions)
    df = architecture.coupling(members, exports, functions)
    rows = df.collect()
    assert shuffled(df._jdf.queryExecution().executedPlan()) < 10e6  # texts end at the automaton
    # Every name is mentioned by its own file and by the file of one other function.
    other = {(7 * i) % 3000: i for i in range(3000)}
    want = {f"m{m}/sub": sum(other[i] % 50 != m for i in range(m, 3000, 50)) / 60 for m in range(50)}
    assert {r.root_path: r.coupling for r in rows} == pytest.approx(want)


def test_coupling_of_small_modules(spark):
    files = files_of(spark, "a/x/1.ts", "a/x/2.ts", "b/y/1.ts", "b/y/2.ts")
    functions = functions_of(spark, ("a/x/1.ts", "one", True), ("a/x/2.ts", "two", True), ("b/y/1.ts", "callone", False), ("b/y/2.ts", "z", True))
    rows = architecture.coupling(architecture.module_members(files), architecture.file_exports(functions), functions).collect()
    assert {r.root_path: r.coupling for r in rows} == {"a/x": 0.5, "b/y": 0.0}
