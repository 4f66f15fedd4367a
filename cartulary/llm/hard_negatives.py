"""Hard-negative mining by one-dimensional distance keys: exact inner-product search over vectors sorted by (pivot, distance).

Vectors are of whole numbers, so scores are exact. With M the greatest norm, a vector x gets a further component sqrt(M² - |x|²), a
query q gets 0; then the squared distance of q and x is M² + |q|² - 2qx, and the best scores are the nearest vectors.

Index: pivots are the centres of a bounded sample; every vector belongs to its nearest pivot and has its distance as key. A pivot's
keys are cut into bins, bins into blocks of some BLOCK vectors, and the blocks are stored in order of pivot and key, a row each.

Search: by the triangle inequality a vector in a bin with keys from lo to hi is at least max(d - hi, lo - d) away from a query at
distance d from the pivot. Each round scans, for each query, the bins with the least such bounds, four times as many vectors as
before, and leaves out those beyond the distance of what it has found. A query is done when the bound of all bins that are left is
greater than the distance of its k-th result, which certifies it; the last round reaches every bin.

Equal vectors of one label are one class; of its members only the first few by id can come first anywhere, so copies cost one
vector in the index and one query, however many there are. Queries meet blocks as rows of up to SLICE queries, in joins by block that Spark may split.

Rows without a vec_id, label or vector, or with a component that is null or not finite, take no part. Rows that repeat wholly count
once; rows with one vec_id and other contents are different rows. Shorter vectors count as padded with zeros. Empty tables give no
rows, other columns are not read. Products are exact while sums of products stay under 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.shared import scratch, table, written

#: Vectors, those with the least hash, from which pivots are learned; at most so many pivots, and bins of each.
SAMPLE, PIVOTS, BINS = 20_000, 256, 64
BLOCK = 1024
SLICE = 256
#: Vectors that a query meets in the first round, about.
FIRST_ROWS = 4096
#: No limit of a score.
ANY = 1 << 62

_FOUND = "cls long, hi long, score long, id long, other long"


def labelled_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the rows that take part, with whole numbers as components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec")).distinct()


def vector_classes(rows: DataFrame, members: int) -> DataFrame:
    """(cls, label, vec, ids): equal vectors of one label, with the first ids of each. The window keeps so many a task before its shuffle."""
    keyed = rows.withColumn("cls", F.xxhash64("label", "vec"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("cls", "label", "vec").orderBy("vec_id"))).filter(F.col("n") <= members)
    return first.groupBy("cls", "label", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows, padded with zeros."""
    flat = column.flatten().to_numpy()
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    of = np.repeat(np.arange(len(column)), sizes)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _augmented(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with the further component that makes all norms equal."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1), 0))


def learn_pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of the sample's augmented vectors, by Lloyd's rounds from its first n."""
    pivots = sample[:n].copy()
    for _ in range(rounds if len(sample) else 0):
        near = _distances(sample, pivots).argmin(axis=1)
        size = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots[size > 0] = sums[size > 0] / size[size > 0, None]
    return pivots


class Index:
    """Vectors by (pivot, distance). blocks: a row (pivot, bin, block, n, cls, label, ids, vecs) for each block, written in key order."""

    def __init__(self, classes: DataFrame):
        """classes: a written table (cls, label, vec, ids)."""
        spark = classes.sparkSession
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        size = classes.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
        self.n, self.square, self.dims = size[0], size[1] or 0.0, size[2] or 0
        self.kind = next(k for k in ("<i2", "<i4", "<i8") if (size[3] or 0) <= np.iinfo(k).max)
        self.exact = self.square < 2**53  # scores in floating point are whole numbers, without rounding
        sample = classes.select("cls", "vec").orderBy(F.xxhash64("cls", F.lit(5)), "cls").limit(SAMPLE).toArrow()
        vecs = _augmented(_matrix(sample.column("vec").combine_chunks(), self.dims), self.square)
        self.pivots = learn_pivots(vecs, int(np.clip(self.n**0.5 / 2, 1, PIVOTS)))
        keyed = written(classes.mapInArrow(self._keys(), "cls long, label int, ids array<long>, vec binary, pivot int, key double"), "keys")
        ends = keyed.groupBy("pivot").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # a row a pivot
        cuts = spark.createDataFrame([(r.pivot, r.lo, (r.hi - r.lo) or 1.0, int(np.clip(r.n // BLOCK, 1, BINS))) for r in ends], "pivot int, lo double, width double, bins int")
        number = F.least(F.floor((F.col("key") - F.col("lo")) / F.col("width") * F.col("bins")), F.col("bins") - 1).cast("int")
        binned = keyed.join(F.broadcast(cuts), "pivot").withColumn("bin", number)
        found = binned.groupBy("pivot", "bin").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("pivot", "bin").collect()  # PIVOTS * BINS rows at most
        self.bins = {c: np.array([r[c] for r in found]) for c in ("pivot", "bin", "lo", "hi", "n")}
        self.bins["blocks"] = -(-self.bins["n"] // BLOCK)
        spread = spark.createDataFrame([(r.pivot, r.bin, int(-(-r.n // BLOCK))) for r in found], "pivot int, bin int, blocks int")
        member = F.struct("key", "cls", "label", "ids", "vec")
        packed = binned.join(F.broadcast(spread), ["pivot", "bin"]).withColumn("block", F.pmod(F.col("cls"), F.col("blocks")).cast("int"))
        packed = packed.groupBy("pivot", "bin", "block").agg(F.array_sort(F.collect_list(member)).alias("m"))  # some BLOCK each
        packed = packed.select("pivot", "bin", "block", *(F.col("m")[c].alias(c) for c in ("cls", "label", "ids")), F.col("m.vec").alias("vecs"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = written(packed.repartitionByRange(parts, "pivot", "bin", "block").sortWithinPartitions("pivot", "bin", "block"), "blocks", keep=True)

    def _keys(self):
        pivots, square, dims, kind = self.pivots, self.square, self.dims, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("vec"), dims)
                d = _distances(_augmented(x, square), pivots)
                near = d.argmin(axis=1)
                vecs = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                yield pa.record_batch([b.column("cls"), b.column("label"), b.column("ids"), vecs, pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near])], names=["cls", "label", "ids", "vec", "pivot", "key"])

        return run

    def _probes(self, since: int, until: int):
        """Queries (cls, label, vec, targets) -> a row for each block to scan of the bins that begin within so many vectors, nearest first."""
        pivots, square, dims, kind, bins = self.pivots, self.square, self.dims, self.kind, self.bins
        slack = 1e-6 * (1 + square**0.5)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, at = [], []
                for i in range(b.num_rows):
                    q = np.frombuffer(b.column("vec")[i].as_buffer(), kind).astype(np.float64)
                    targets = b.column("targets")[i].values
                    hi, bound = targets.field("hi").to_numpy(), targets.field("bound").to_numpy()
                    far = np.sqrt(np.maximum(square + q @ q - 2.0 * bound.min(), 0)) + slack
                    close = np.sqrt(np.maximum(square + q @ q - 2.0 * hi.max(), 0)) - slack
                    d = _distances(np.append(q, 0.0)[None], pivots)[0][bins["pivot"]]
                    least = np.maximum(np.maximum(d - bins["hi"], bins["lo"] - d), 0)
                    order = np.argsort(least, kind="stable")
                    before = np.cumsum(bins["n"][order]) - bins["n"][order]
                    take = order[(before >= since) & (before < until) & (least[order] <= far) & ((d + bins["hi"])[order] >= close)]
                    take = np.repeat(take, bins["blocks"][take])
                    at.append(take)
                    rows.append(np.full(len(take), i))
                take, of = np.concatenate(at), pa.array(np.concatenate(rows))
                new = np.ones(len(take), bool)
                new[1:] = (take[1:] != take[:-1]) | (np.asarray(of)[1:] != np.asarray(of)[:-1])
                first = np.flatnonzero(new)
                block = np.arange(len(take)) - first[np.cumsum(new) - 1] if len(take) else take
                yield pa.record_batch([
                    pa.array(bins["pivot"][take], pa.int32()), pa.array(bins["bin"][take], pa.int32()), pa.array(block, pa.int32()), *(b.column(c).take(of) for c in ("cls", "label", "vec", "targets")),
                ], names=["pivot", "bin", "block", "q", "q_label", "q_vec", "targets"])

        return run

    def _scan(self, same: bool, k: int):
        """Rows (queries, block) -> the k best of each query and target in the block."""
        dims, kind, exact = self.dims, self.kind, self.exact

        def vectors(values: pa.Array) -> np.ndarray:
            raw = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in values), kind).reshape(len(values), dims)
            return raw.astype(np.float64 if exact else np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    x, q = vectors(b.column("vecs")[i].values), b.column("queries")[i].values
                    scores = (vectors(q.field("q_vec")) @ x.T).astype(np.int64)
                    cls, label, ids = b.column("cls")[i].values.to_numpy(), b.column("label")[i].values.to_numpy(), b.column("ids")[i].values
                    first, flat = np.asarray(ids.offsets) - ids.offsets[0].as_py(), ids.flatten().to_numpy()
                    q_cls, q_label, targets = q.field("q").to_numpy(), q.field("q_label").to_numpy(), q.field("targets")
                    found: list[np.ndarray] = []
                    for j in range(len(q)):
                        t = targets[j].values
                        fits = (label == q_label[j]) == same
                        for hi, bound in zip(t.field("hi").to_pylist(), t.field("bound").to_pylist(), strict=True):
                            s = scores[j]
                            at = np.flatnonzero(fits & (s <= hi) & (s >= bound))
                            if not len(at):
                                continue
                            at = at[np.lexsort((flat[first[at]], -s[at]))[:k]]  # classes by score and first id
                            rows = np.array([(q_cls[j], hi, s[a], m, cls[a]) for a in at for m in flat[first[a] : first[a + 1]]], np.int64)
                            found.append(rows[np.lexsort((rows[:, 3], -rows[:, 2]))[:k]])
                    out = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
                    yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in out.T], names=["cls", "hi", "score", "id", "other"])

        return run

    def search(self, queries: DataFrame, limits: DataFrame, k: int, same: bool) -> DataFrame:
        """(cls, hi, score, id, other, rank): the k best rows of each query (a written table cls, label, vec) and limit (cls, hi, lo), with lo <= score <= hi.

        same: whether their label is the query's. other: the class of the row found. Exact.
        """
        spark = queries.sparkSession
        slices = -(-queries.count() // SLICE)
        best = Window.partitionBy("cls", "hi").orderBy(F.col("score").desc(), "id", "other")
        found = spark.createDataFrame([], f"{_FOUND}, rank int")
        since, until = 0, FIRST_ROWS
        while since < self.n:
            last = found.groupBy("cls", "hi").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
            bound = F.when(F.col("n") >= k, F.greatest("lo", "kth")).otherwise(F.col("lo"))
            targets = limits.join(last, ["cls", "hi"], "left").groupBy("cls").agg(F.collect_list(F.struct("hi", bound.alias("bound"))).alias("targets"))  # k + 1 limits at most
            probes = queries.join(targets, "cls").select("cls", "label", "vec", "targets").mapInArrow(
                self._probes(since, until), "pivot int, bin int, block int, q long, q_label int, q_vec binary, targets array<struct<hi: long, bound: long>>")
            probes = probes.groupBy("pivot", "bin", "block", F.pmod(F.xxhash64("q"), F.lit(max(slices, 1))).alias("slice")).agg(F.collect_list(F.struct("q", "q_label", "q_vec", "targets")).alias("queries"))
            probes = written(probes, "probes")
            if probes.isEmpty():
                break
            more = probes.join(self.blocks.hint("merge"), ["pivot", "bin", "block"]).select("queries", "cls", "label", "ids", "vecs").mapInArrow(self._scan(same, k), _FOUND)
            both = more.union(found.drop("rank")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            found = written(both, "found", keep=True)
            since, until = until, until * 4
        return found


def hard_negatives(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, margin: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best `positives` rows of
    its label, the best `negatives` rows of other labels that score from margin % of the positive's score up to it. rows: vec_id, label, vec (whole numbers)."""
    with scratch():
        rows = written(rows, "rows")
        anchors = written(rows.filter(F.col("vec_id") % anchor_every == 0).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "vec").alias("cls")), "anchors", keep=True)
        index = Index(written(vector_classes(rows, max(positives + 1, negatives)), "classes"))
        flat = index.blocks.select(F.explode(F.arrays_zip("cls", "label", "vecs")).alias("m")).select("m.cls", "m.label", F.col("m.vecs").alias("vec"))
        queries = written(flat.join(anchors.select("cls").distinct(), "cls", "left_semi"), "queries")
        near = index.search(queries, queries.select("cls", F.lit(ANY).alias("hi"), F.lit(-ANY).alias("lo")), positives + 1, same=True)
        # score * 100 >= margin * hi, in whole numbers
        limits = near.filter("score >= 0").select("cls", F.col("score").alias("hi"), F.expr(f"(score * {margin} + 99) div 100").alias("lo")).distinct()
        mined = index.search(queries, written(limits, "limits"), negatives, same=False)
        near, mined = written(near, "near", keep=True), written(mined, "mined", keep=True)
    own = anchors.join(near.select("cls", "id", "score", "other").hint("merge"), "cls").filter(~((F.col("other") == F.col("cls")) & (F.col("id") == F.col("anchor_id"))))
    order = Window.partitionBy("anchor_id", "cls").orderBy(F.col("score").desc(), "id", "other")
    pairs = own.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives).select("anchor_id", "cls", F.col("id").alias("positive_id"), F.col("score").alias("hi"))
    out = pairs.join(mined.select("cls", "hi", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge"), ["cls", "hi"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("hi").alias("positive_score"), "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Contract query: hard negatives of every hundredth row of `embeddings`, against all rows."""
    return hard_negatives(labelled_rows(table(spark, sf_dir, "embeddings")))


OP12_SQL = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda x: CAST(floor(x * 256) AS BIGINT)) AS v
  FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT row_number() OVER () AS rid, * FROM f),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS n FROM s WHERE same QUALIFY n <= 5),
m AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.rid, p.n ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 5
"""
