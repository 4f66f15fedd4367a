"""Quality rules by host, native (DataFrame functions only).

Per document the base rules are counted inside the row; failures are summed by host (here: source), each host's failure rate is
shrunk towards an empirical beta prior fitted by moments over all hosts, and hosts whose shrunk rate exceeds a limit are rejected
with all their documents. Null texts have no words and fail; a null host is a host of its own. Rows that repeat are judged and
counted each; an empty table has no hosts and no rows; other columns pass through, the counts are packed in one struct, `rules`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import table, written

SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def tail(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _repeats(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more. Windows are sorted as (hash, position); neighbours with equal hashes are repeats."""
    def windows(h: Column) -> Column:
        n = F.size(h) - 2
        pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
        return pair(pair(F.slice(h, 1, n), F.slice(h, 2, n)), F.slice(h, 3, n))

    def covered(p: Column) -> Column:
        return F.coalesce(F.aggregate(F.zip_with(p, tail(p, 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x), F.lit(0))

    def marked(s: Column) -> Column:
        after = F.zip_with(s, tail(s, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull()))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    body = lambda t: F.when(  # noqa: E731  most short texts repeat no window: a set tells, without the sort
        F.size(F.array_distinct(t)) < F.size(t),
        let(let(F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked), covered),
    ).otherwise(0)
    return F.when(F.size(words) > 2, let(let(hashes, windows), body)).otherwise(0).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in a struct column `rules`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    counts = F.struct(
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).alias("n_repeat_words"))).alias("w"),
    )
    return docs.withColumn("rules", let(counts, lambda c: F.struct(
        c["w"]["n_words"].alias("n_words"), c["w"]["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"), c["w"]["n_repeat_words"].alias("n_repeat_words"),
        ((c["w"]["n_words"] < 50) | (100 * c["w"]["n_repeat_words"] > 50 * c["w"]["n_words"])).alias("base_failed"),
    )))


def host_verdicts(rules: DataFrame, host: str = "source", max_rate: float = 0.6) -> DataFrame:
    """Per host: docs, failed, shrunk_rate, rejected. rules: a row per document with the host and base_failed.

    The prior beta(a, b) has the hosts' mean failure rate m and variance v (unweighted, population): a + b = m(1-m)/v - 1, at
    least 2 and at most 10,000; with one host or no variance, 10,000 is taken, so that all hosts come near the mean.
    """
    hosts = rules.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = prior.m or 0.0, prior.v or 0.0
    k = max(2.0, min(1e4, m * (1 - m) / v - 1)) if v > 1e-12 else 1e4
    shrunk = (F.col("failed") + m * k) / (F.col("docs") + k)
    return hosts.select("host", "docs", "failed", shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("rejected"))


def host_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.6) -> DataFrame:
    """A row per document: doc_id, host, the base counts, base_failed, host_rejected, kept.

    The counts are written once, without texts; hosts are summed with partial aggregates, so a host with a third of all documents is
    no heavier than others, and come back by a join that Spark broadcasts or splits.
    """
    rules = written(base_rules(docs.select("doc_id", "text", F.col(host).alias("host"))).select("doc_id", "host", "rules.*"), "host-rules")
    verdicts = host_verdicts(rules, "host", max_rate).select(F.col("host").alias("h"), "rejected")
    return rules.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left").select(
        *rules.columns, F.coalesce("rejected", F.lit(False)).alias("host_rejected"), (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))


def op9_host_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document with its counts and verdict."""
    return host_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), t AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM t
), p AS (
  SELECT DISTINCT rid, i + d AS pos FROM g, (VALUES (0), (1), (2)) AS o(d) WHERE c > 1
), r AS (SELECT rid, count(*) AS n FROM p GROUP BY rid),
l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), b AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM f GROUP BY source),
m AS (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(2.0, least(1e4, m * (1 - m) / v - 1)) ELSE 1e4 END AS k FROM m),
j AS (SELECT source, (failed + m * k) / (docs + k) > 0.6 AS rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT j.rejected AS kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
"""
