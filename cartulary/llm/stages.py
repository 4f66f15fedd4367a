"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

docs has the columns of documents and any others, which pass through; names that a stage uses inside begin with two underscores or
are packed away, so docs' own may clash with any others. All stages but the last return docs' columns. A row is known by its doc_id
and the hash of its text; rows that repeat are told apart by a number where it matters. No stage needs a row: empty tables give
empty results. What each does with nulls and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.llm.decontaminate import clean
from cartulary.llm.host_rules import base_rules, host_verdicts
from cartulary.llm.minhash import near_duplicates
from cartulary.llm.mixing import mixture
from cartulary.llm.packing import pack
from cartulary.llm.shared import doc_key, row_key, scratch, table, written

_KEY = ["__doc", "__row"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__doc": doc_key(), "__row": row_key()})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose base rules pass and whose host isn't rejected.

    The rules are counted once: documents that pass are written with their columns, the others with host and verdict only. Null and
    empty texts have no words and are rejected; a null source is a host of its own; rows that repeat are judged and counted each."""
    rules = base_rules(docs.select(F.struct("*").alias("all"), "text", F.col("source").alias("host"))).drop("text")
    rules = rules.select("host", "rules.base_failed", "all").withColumn("all", F.when(~F.col("base_failed"), F.col("all")))
    with scratch():
        rules = written(rules, "rules", keep=True)
        rejected = written(host_verdicts(rules, "host").filter("rejected").select(F.col("host").alias("h")), "rejected", keep=True)
    return rules.filter("not base_failed").join(rejected, F.col("host").eqNullSafe(F.col("h")), "left_anti").select("all.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id.

    Of rows that repeat one stays; a null doc_id counts as the smallest. Texts without words are alike to nothing and stay, but for repeats."""
    with scratch():
        kept = near_duplicates(docs, n=5).filter("kept").select(doc_key().alias("__doc"), F.col("row").alias("__row")).distinct()
        kept = written(kept, "kept", keep=True)
    rows = _keyed(docs).join(kept.hint("merge"), _KEY, "left_semi")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*_KEY).orderBy(*_KEY)))
    return first.filter("__n = 1").drop("__n", *_KEY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts stay, rows that repeat stay or go together, an empty benchmark keeps all."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A text without words takes none, and stays as often as its place in the order of keys says; a null source is
    a source of its own; rows that repeat are taken as often as all of them together."""
    with scratch():
        taken = mixture(docs).select(doc_key().alias("__doc"), F.col("row").alias("__row"), "epochs")
        taken = written(taken.groupBy(*_KEY).agg(F.sum("epochs").alias("__epochs"), F.count(F.lit(1)).alias("__copies")).filter("__epochs > 0"), "taken", keep=True)
    rows = _keyed(docs).join(taken.hint("merge"), _KEY)
    rows = rows.withColumn("__n", F.when(F.col("__copies") > 1, F.row_number().over(Window.partitionBy(*_KEY).orderBy(*_KEY))).otherwise(1))
    times = F.floor((F.col("__epochs") + F.col("__copies") - F.col("__n")) / F.col("__copies")).cast("int")
    return rows.withColumn("__time", F.explode(F.array_repeat(F.lit(0), times))).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids. A null or empty text is its end-of-text id; rows that repeat are packed each."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicate), ("benchmark decontamination", decontamination), ("mixing", mixing), ("token ids", token_ids)]
