"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct n-word shingles (A-Z lower-cased; with fewer words the whole sequence as one; without words
empty). The hash range is cut into BINS bins; the least hash of a bin is its value, and an empty bin borrows from the first
non-empty bin of a random order of its own (the same for all documents), so each value agrees between two documents with
probability their Jaccard similarity. BANDS bands of ROWS values give a document's buckets: at 0.8 a pair shares none with
probability (1 - 0.8**6)**48, under one in a million.

Documents with equal sets are one node, known by a number of its own, whatever doc_ids its rows have. In a bucket only pairs with
the bucket's centre are candidates (the member that shares most buckets with others), so their count stays below the number of
bucket rows, however large a group of copies is. Candidates are confirmed on their full sets, and links give components. Members
of a bucket that are in different components after that are compared too, in blocks (see _rest), so the star loses no link that
components depend on.

Rows that repeat are copies of each other; rows that share a doc_id (or have none) but not the text are judged each by its text.
Of a component the row with the smallest doc_id is kept, of several with that doc_id the one with the smallest hash of the text.
A null doc_id counts as the smallest, and the component it leads has the id null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.graph import components
from cartulary.llm.shared import NO_ID, doc_key, row_key, scratch, table, written
from cartulary.llm.words import CHUNK_BYTES, Words, chunks, kgrams, mix

_SPACE = re.compile(rb"[ \t-\r]")
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Rows of a block, on either side, when what the stars leave open is compared.
FAMILY_BLOCK = 1000
#: Shingles of a block, about (16 MB of hashes, some 100 MB in work).
FAMILY_SHINGLES = 1 << 21


def _orders() -> np.ndarray:
    """Row e: the rank of each bin in empty bin e's order of lenders."""
    h = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0x5EED)).reshape(BINS, BINS)
    return np.argsort(np.argsort(h, axis=1), axis=1).astype(np.int16)


def _long_set(text: bytes, n: int) -> np.ndarray:
    """The set of a text that is too long for one pass, from parts that end at white space; each begins with the n - 1 words before it."""
    sets, before, at = [np.zeros(0, np.uint64)], b"", 0
    while at < len(text):
        space = _SPACE.search(text, at + CHUNK_BYTES)
        end = space.start() if space else len(text)
        part = before + text[at:end]
        w = Words(pa.array([part.decode()]), lower=True)
        sets.append(np.unique(kgrams(w.hash, n)))
        before = part[w.start[-min(n - 1, len(w.start))] :] if n > 1 and len(w.start) else b""
        at = end
    out = np.unique(np.concatenate(sets))
    return out if len(out) else _short_set(w.hash)


def _short_set(words: np.ndarray) -> np.ndarray:
    """One shingle of all words, another for each length."""
    return kgrams(words, len(words)) ^ np.uint64(len(words)) if len(words) else words


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_buffer()) > 2 * CHUNK_BYTES:
        return [_long_set(texts[0].as_buffer().to_pybytes(), n)]
    w = Words(texts, lower=True)
    grams = kgrams(w.hash, n)
    out = []
    for d in range(len(texts)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else _short_set(w.hash[a:b]))
    return out


def signature(u: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set."""
    bins = ((u >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    least = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
    full = bins[least].astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    out[full] = u[least]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = out[full[orders[empty][:, full].argmin(axis=1)]]
    return out


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        bands = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            for b in chunks(batch):
                sets = shingle_sets(b.column("text"), n)
                keys = [mix((signature(u, orders).reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64) + bands) if len(u) else np.zeros(0, np.uint64) for u in sets]
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.record_batch([
                    b.column("doc_id"), b.column("row"), pa.array([len(u) for u in sets], pa.int64()),
                    pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64())),
                ], names=["doc_id", "row", "n_shingles", "digest", "bands"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                yield pa.record_batch([b.column("node"), pa.array([u.tobytes() for u in shingle_sets(b.column("text"), n)], pa.binary())], names=["node", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(s.as_buffer(), np.uint64) for s in b.column("set_a")]
            y = [np.frombuffer(s.as_buffer(), np.uint64) for s in b.column("set_b")]
            ok = []
            for p, q in zip(x, y, strict=True):
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    ok.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, digest of the set, bands (empty for an empty set); written."""
    return written(docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(_signatures(n), "doc_id long, row long, n_shingles long, digest binary, bands array<long>"), "signatures", keep=True)


def set_nodes(sig: DataFrame) -> DataFrame:
    """node (a number of its own), digest, doc and row (the smallest of the set's rows), n, bands of each distinct set; written, which fixes the numbers."""
    least = F.min(F.struct(doc_key().alias("doc"), "row")).alias("least")
    nodes = sig.filter("n_shingles > 0").groupBy("digest").agg(least, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    return written(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least.doc", "least.row", "n", "bands"), "nodes", keep=True)


def similar_components(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that have a link; written."""
    with scratch():
        rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
        shared = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared").hint("merge")  # tables of their own: Spark can split a join at a frequent key
        members = written(rows.join(shared, "bucket"), "buckets")
        degree = members.groupBy("node").agg(F.sum("members").alias("degree"))
        members = written(members.join(degree, "node").select("bucket", "node", "n", "degree"), "members")
        texts = Texts(docs, nodes)

        centre = members.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("c_n"))
        centre = written(centre, "centres").hint("merge")
        near = f"node <> centre and 100 * least(n, c_n) >= {percent} * greatest(n, c_n)"
        pairs = members.join(centre, "bucket").filter(near).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        links = written(_links(written(pairs, "pairs"), texts, n, percent), "links")
        label = components(links)
        more = written(_rest(members.select("bucket", "node", "n"), label, texts, n, percent), "links")
        return written(label if more.isEmpty() else components(links.union(more)), "labels", keep=True)


class Texts:
    """The sets of nodes, made from the text of one row each."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.texts = docs.select(doc_key().alias("doc"), row_key().alias("row"), "text")
        self.nodes = nodes.select("node", "doc", "row")

    def sets(self, needed: DataFrame, n: int) -> DataFrame:
        """(node, set) of the nodes in needed (node, distinct); written."""
        places = written(self.nodes.join(needed, "node"), "needed").hint("merge")
        one = self.texts.join(places, ["doc", "row"]).dropDuplicates(["doc", "row"])
        return written(one.select("node", "text").mapInArrow(_sets(n), "node long, set binary"), "sets")


def _rest(members: DataFrame, label: DataFrame, texts: Texts, n: int, percent: int) -> DataFrame:
    """Links between members of a bucket that are in different components so far.

    A bucket's family is its most frequent component; a pair of different components has an end outside of it. So the members of
    all mixed buckets of a family are taken once, and those outside the family's component are compared with all of them. Both
    sides are cut into blocks of about FAMILY_BLOCK rows or FAMILY_SHINGLES shingles, whatever is less, a task for each pair of
    blocks, in which an index of the members' shingles is asked for each row outside, without a row for each pair. With u of m
    members outside, a member goes to as many tasks as u have blocks, and a row outside to as many more as m have.
    """
    rows = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("members"), F.count(F.lit(1)).alias("components")).filter("components > 1 and members > 2")
    kin = written(rows.join(mixed.select("bucket", F.col("top.component").alias("family")), "bucket").select("family", "node", "n", "component").distinct(), "kin")
    sets = texts.sets(kin.select("node").distinct(), n)
    cut = lambda w: F.ceil(F.greatest(F.count_if(w) / FAMILY_BLOCK, F.sum(F.when(w, F.col("n")).otherwise(0)) / FAMILY_SHINGLES)).cast("int")
    sizes = kin.groupBy("family").agg(cut(F.lit(True)).alias("blocks"), cut(F.col("component") != F.col("family")).alias("asked"))
    kin = kin.join(sizes, "family")
    block = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = kin.filter("asked > 0").select("family", every("asked").alias("i"), block(1, "blocks").alias("j"), "node", "component", F.lit(False).alias("asks"))
    asking = kin.filter("component <> family").select("family", block(2, "asked").alias("i"), every("blocks").alias("j"), "node", "component", F.lit(True).alias("asks"))
    return held.union(asking).join(sets, "node").groupBy("family", "i", "j").applyInArrow(_compare(percent), "a long, b long").distinct()


def _compare(percent: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        held, asking = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        of = lambda t: (t.column("node").to_numpy(), t.column("component").to_numpy(), [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("set")])
        node, component, sets = of(held)
        out: list[tuple[int, int]] = []
        if len(sets):
            size = np.array([len(s) for s in sets])
            known, ids = np.unique(np.concatenate(sets), return_inverse=True)
            holder = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]  # by shingle: the rows that hold it
            first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(known)))])
            for a, c, s in zip(*of(asking), strict=True):
                at = np.searchsorted(known, s)
                at = at[known[np.minimum(at, len(known) - 1)] == s]
                if not len(at):
                    continue
                common = np.bincount(np.concatenate([holder[first[t] : first[t + 1]] for t in at]), minlength=len(sets))
                hit = (100 * common >= percent * (len(s) + size - common)) & (component != c)
                out += [(min(a, b), max(a, b)) for b in node[hit].tolist()]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _links(pairs: DataFrame, texts: Texts, n: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = texts.sets(needed, n)
    x, y = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").mapInArrow(_confirm(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, row (hash of the text), n_shingles, component_id, kept."""
    with scratch():
        sig = signatures(docs, n)
        nodes = set_nodes(sig)
        label = similar_components(docs, nodes, n, percent)
        first = label.join(nodes.select("node", "doc", "row"), "node").groupBy("component").agg(F.min(F.struct("doc", "row")).alias("first"))
        of_node = written(label.join(written(first, "firsts").hint("merge"), "component").select("node", "first"), "of-nodes", keep=True)
    of_set = nodes.select("digest", "node", "doc", "row").join(of_node, "node", "left").select("digest", F.coalesce("first", F.struct("doc", "row")).alias("first"))
    own = F.struct(doc_key().alias("doc"), "row")
    rows = sig.select("doc_id", "row", "n_shingles", "digest").join(of_set, "digest", "left").withColumns({"own": own, "first": F.coalesce("first", own)})
    return rows.select("doc_id", "row", "n_shingles", F.when(F.col("first.doc") != NO_ID, F.col("first.doc")).alias("component_id"), (F.col("first") == F.col("own")).alias("kept"))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """All documents by two-word shingles at 80 percent: doc_id, n_shingles, component_id, kept (doc_id = component_id, also where rows share a doc_id or have none; a null id is the smallest)."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=2).drop("row").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Brute force over all pairs that share a shingle; for small tables only.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(words) > 1 THEN [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] ELSE words END) AS k FROM w WHERE len(words) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid, rid AS reached FROM w UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT r.rid, CASE WHEN count(doc_id) = count(*) THEN min(doc_id) END AS component_id FROM r JOIN w ON w.rid = r.reached GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
