"""Mixing sources to target weights.

Every document gets a key from a hash of its id. A source's key range is cut into equal sub-ranges of about RANGE_ROWS documents
(the keys are uniform, so the cuts need no sample and are the same in every run); sizes are summed by sub-range, prefix sums over
those give each sub-range its start, and a window over one sub-range gives each document its interval of the source's words. No
task sees more than a sub-range, however large its source.

A source's target is a number of whole epochs and a rest. The rest goes to the documents in key order up to the budget: the
document in which it ends is taken if the budget reaches its middle, so a source misses its target by half a document at most.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; shares of the sum of all sizes; a source stops at max_epochs
times its size, and the excess goes to the others by weight. Null and empty texts have size 0. Rows with one doc_id (or none) go in
the order of size and a hash of the text, so the mix doesn't depend on how the input is split. Rows that repeat are told apart by
nothing, and either may be the one that is taken.

The sources are ranked in one task's window: a row each (some 60 bytes), so a million of them are small; documents never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.shared import WORD, row_key, scratch, table, written

WEIGHTS = (5, 2, 1)
RANGE_ROWS = 4_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sizes (source, size, docs: a row per source) with the column target.

    In the order of cap / weight, a source is capped if the level (what the capped before it leave, by the weight of those not
    before it) reaches its cap; the others get the level of the first that isn't.
    """
    code = F.hex(F.encode("source", "UTF-8"))  # the order of UTF-8 bytes is the order of code points
    s = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), code)))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double"))
    s = s.withColumn("cap", F.col("size") * float(max_epochs))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * free)).select("source", "size", "docs", "target")


def with_key(docs: DataFrame) -> DataFrame:
    """docs with size, key (60 bits) and row (hash of the text)."""
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{SEED}"))), 1, 15), 16, 10).cast("long")
    return docs.withColumns({"row": row_key(), "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "key": key})


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """A row per document: doc_id, row (hash of the text), source, size, source_size, target, epochs (times that it is taken), taken."""
    with scratch():
        rows = written(with_key(docs.select("doc_id", "source", "text")).drop("text"), "sizes", keep=True)
        sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")), weights, max_epochs), "targets", keep=True)
    goal = sources.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE_ROWS)).alias("ranges"))
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges")))
    starts = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    starts = starts.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")).alias("start"))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("before", F.col("start") + F.sum("size").over(within) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    epochs = whole + F.when(F.col("before") + F.col("size") / 2 < rest, 1).otherwise(0)
    return placed.withColumn("epochs", epochs.cast("int")).select("doc_id", "row", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).cast("long").alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken (words)."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: (Rows with equal doc_id and size are in any order here: they differ in the text only, which the result doesn't have.)
#: The mix of a view `docs` (doc_id, text, source) in DuckDB: view `mixed` has doc_id, text, lang, source, n_chars, size, source_size, target, epochs.
MIX_CTES = r"""
z AS (SELECT row_number() OVER () AS rid, *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/mix-1'), 1, 15) AS BIGINT) AS key FROM docs),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source IS NULL, hex(encode(source))) AS rank FROM z GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, size * CAST(3 AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, (sum(size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, size AS source_size, CASE WHEN cap <= level * weight THEN cap ELSE weight * (SELECT min_by(level, cap / weight) FROM s2 WHERE cap > level * weight) END AS target FROM s2),
z1 AS (SELECT z.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
  sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM z JOIN s3 ON z.source IS NOT DISTINCT FROM s3.source),
mixed AS (SELECT *, CAST(whole + CASE WHEN before + size / 2 < target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM z1)
"""
OP8_SQL = f"WITH docs AS (SELECT * FROM documents), {MIX_CTES} SELECT doc_id, size, source_size, target, CAST(epochs * size AS BIGINT) AS taken FROM mixed"
