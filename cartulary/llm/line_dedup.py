"""Line dedup: range-partitioned line hashes, secondary sort by document and position, keep bitmaps.

Every line long enough gives a row (128-bit hash of its key, doc_id, row hash, position). The rows are range-partitioned by
(hash, doc_id), so that a line which a third of all documents hold spreads over many partitions, and sorted by hash, then
doc_id from the largest, then position. A partition streams them: the first document of a key keeps its lines, the others drop
theirs once the key is known to have min_docs documents. Only a key that touches a partition's edge can go on in another
partition: its rows are put off, and a summary of at most two keys a partition, merged by key, decides them.

Returned are per-document keep bitmaps (zlib; bit i of byte i // 8 is line i), not texts.

Rows are known by (doc_id, hash of the text): rows that repeat get the same bitmap, rows with one doc_id count as one document.
A null doc_id counts as the smallest. Null and empty texts are one empty line.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import WHITE, doc_key, row_key, scratch, table, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = "kind int, h1 long, h2 long, doc long, row long, pos int, n long"
#: Kinds of rows that a partition gives.
DROP, OPEN, EDGE = 0, 1, 2
#: Lines of a range partition, about; there are at least as many partitions as the session shuffles into.
RANGE_ROWS = 4_000_000


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select(doc_key().alias("doc"), row_key().alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(WHITE))).filter(F.length("line") >= min_chars)
    lower = F.when(F.col("line").rlike("[A-Z]"), F.translate("line", _UPPER, _LOWER)).otherwise(F.col("line"))
    return keyed.withColumn("line", lower).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "doc", "row", "pos")


def _stream(min_docs: int):
    """Decides what a partition can; rows come sorted by h1, h2, doc from the largest, row, pos."""
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])

    def whole(a: dict[str, np.ndarray], ends: tuple[bool, bool]) -> pa.RecordBatch:
        """a: rows of whole keys. ends: whether the first and the last key touch the partition's edge."""
        n = len(a["h1"])
        new_key = np.ones(n, bool)
        new_key[1:] = (a["h1"][1:] != a["h1"][:-1]) | (a["h2"][1:] != a["h2"][:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= a["doc"][1:] != a["doc"][:-1]
        key = np.cumsum(new_key) - 1
        at = np.flatnonzero(new_key)
        docs = np.bincount(key, weights=new_doc).astype(np.int64)
        edge = np.zeros(len(at), bool)
        edge[0] |= ends[0]
        edge[-1] |= ends[1]
        drop = ~edge[key] & (docs[key] >= min_docs) & (a["doc"] != a["doc"][at][key])
        rows = np.flatnonzero(drop | edge[key])
        sums = np.flatnonzero(edge)
        take = np.concatenate([rows, at[sums]])
        kind = np.concatenate([np.where(drop[rows], DROP, OPEN), np.full(len(sums), EDGE)]).astype(np.int32)
        count = np.concatenate([np.zeros(len(rows), np.int64), docs[sums]])
        return pa.record_batch([kind, a["h1"][take], a["h2"][take], a["doc"][take], a["row"][take], a["pos"][take], count], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            a = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "row", "pos")}
            if held is not None:
                a = {c: np.concatenate([held[c], a[c]]) for c in a}
            last = np.flatnonzero((a["h1"] != a["h1"][-1]) | (a["h2"] != a["h2"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = {c: x[cut:] for c, x in a.items()}
            if cut:
                yield whole({c: x[:cut] for c, x in a.items()}, (first, False))
                first = False
        if held is not None:
            yield whole(held, (first, True))

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, row (hash of the text), n_dropped, keep (zlib bitmap up to the byte of the last dropped line; lines beyond it stay); no row where all stay."""
    with scratch():
        # Written first: the sample for the ranges and the shuffle read hashes, not texts.
        rows = written(line_rows(docs, min_chars), "line-rows")
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
        ranged = rows.repartitionByRange(parts, "h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "row", "pos")
        seen = written(ranged.mapInArrow(_stream(min_docs), _ROWS), "line-dedup", keep=True)
    edges = F.broadcast(  # two rows a partition at most
        seen.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.max("doc").alias("largest"), F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs)
    )
    late = seen.filter(F.col("kind") == OPEN).join(edges, ["h1", "h2"]).filter(F.col("doc") != F.col("largest"))
    drops = seen.filter(F.col("kind") == DROP).select("doc", "row", "pos").union(late.select("doc", "row", "pos"))
    return drops.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("drops")).mapInArrow(_bitmaps, "doc long, row long, n_dropped long, keep binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for pos in b.column("drops"):
            bits = np.ones((pos.values[-1].as_py() // 8 + 1) * 8, np.uint8)  # ones fill the last byte
            bits[pos.values.to_numpy()] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.record_batch([b.column("doc"), b.column("row"), pa.array([len(x.values) for x in b.column("drops")], pa.int64()), pa.array(out, pa.binary())], names=["doc", "row", "n_dropped", "keep"])


def kept_lines(lines: list[str], keep: bytes | None) -> list[str]:
    """The lines whose bit is set, or that lie beyond the bitmap."""
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, dropped, sha = [], [], []
        for text, keep in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            kept = kept_lines(lines, keep)
            n.append(len(lines))
            dropped.append(len(lines) - len(kept))
            sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """A row per document: doc_id, text, keep (null: all lines stay)."""
    docs = docs.select("doc_id", "text")
    with scratch():
        maps = written(keep_bitmaps(docs, min_chars, min_docs), "line-bitmaps", keep=True).drop("n_dropped").hint("merge")
    keyed = docs.withColumns({"doc": doc_key(), "row": row_key()})
    return keyed.join(maps, ["doc", "row"], "left").select("doc_id", "text", "keep")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's lines (of 20 code points, in 3 documents): doc_id, n_lines, n_dropped and the hash of the kept lines."""
    return line_dedup(table(spark, sf_dir, "documents")).mapInArrow(_applied, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, doc, unnest(range(1, len(lines) + 1)) AS i, lines FROM d),
t AS (SELECT rid, doc_id, doc, i, lines[i] AS line, translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
k AS (SELECT k, max(doc) AS top FROM t WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc) >= 3),
j AS (SELECT rid, t.doc_id, i, line, top IS NOT NULL AND t.doc <> top AS gone FROM t LEFT JOIN k USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
