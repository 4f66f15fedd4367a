"""Quality classifier: Bradley-Terry ranking from preference pairs, thresholded by score quantile.

A document of label 1 is preferred to one of label 0. The strength of a document is linear in features of its text, so a pair's
logistic loss depends on the difference of the two feature vectors; the weights are fitted by Newton's method on pairs drawn from
a bounded sample of the labelled rows (at most TRAIN_ROWS, those with the least hash of doc_id, outside the held-out third).
The threshold is the quantile of the sample's strengths at the sample's share of label 0; the score is the logistic function of
the strength above it, so 0.5 is the threshold. All features are counted in the JVM over whole texts and written once.

Without labelled rows of both kinds every score is 0.5. Null and empty texts have features (zeros) and so a score. A label's null
quality isn't used; a doc_id labelled more than once counts once for each label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.host_rules import SPACE, let, tail
from cartulary.llm.shared import table, written

TRAIN_ROWS = 20_000
PAIRS = 100_000
FEATURES = ("log_words", "word_length", "odd", "capitals", "repeated_pairs", "repeated_lines", "stops")


def features(text: Column) -> Column:
    """Array of FEATURES, each between 0 and about 1."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    share = lambda n, of: n / F.greatest(of, F.lit(1))
    fewer = lambda a: let(a, lambda x: share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))

    def of_words(w: Column) -> Column:
        pairs = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), tail(h, 1), lambda a, b: F.xxhash64(a, b)))
        chars = F.length(F.array_join(w, ""))
        return let(F.struct(F.size(w).alias("n"), chars.alias("chars"), fewer(pairs).alias("pairs")), lambda c: F.array(
            F.log1p(c["n"]) / 10,
            F.least(share(c["chars"], c["n"]) / 20, F.lit(2.0)),
            share(F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s.,;:'\"()-]")), c["chars"]),
            share(F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")), c["chars"]),
            c["pairs"],
            fewer(lines),
            share(F.regexp_count(text, F.lit(r"[.,;:]")), c["n"]),
        ))

    return let(words, of_words)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and threshold from feature rows x and labels y."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0
    draw = np.random.default_rng(seed)
    d = good[draw.integers(len(good), size=PAIRS)] - bad[draw.integers(len(bad), size=PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(x @ w)
    k = int((y == 0).sum())
    return w, float((s[k - 1] + s[k]) / 2)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = written(docs.select("doc_id", held.alias("held_out"), features(F.col("text")).alias("x")), "features")
    known = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    share = min(1.0, 1.2 * TRAIN_ROWS / max(1, known.count()))  # so that each task has its share of the sample to sort, not all of it
    known = known.filter(order / 2.0**63 <= share).hint("merge")
    train = rows.filter(~F.col("held_out")).join(known, "doc_id").orderBy(order, "doc_id", "quality", "x").limit(TRAIN_ROWS).select("x", "quality").collect()
    w, threshold = fit(np.array([r.x for r in train]).reshape(-1, len(FEATURES)), np.array([r.quality for r in train]))
    strength = sum((F.col("x")[i] * float(w[i]) for i in range(len(w))), F.lit(-threshold))
    score = F.lit(1.0) / (1 + F.exp(-strength))
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, scored with weights fitted on `labels`: doc_id, held_out, score, predicted."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
