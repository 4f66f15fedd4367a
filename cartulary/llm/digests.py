"""Improbable-feature digests: a text's rarest byte windows, kept in a chain of Bloom filters, and the likeness of two texts by them.

1. Every window of WINDOW bytes has an entropy, in thousandths of the greatest possible. How often each value occurs in the corpus
   is counted over all windows of all texts, and gives its rank: the rarest first. Windows of very low entropy say nothing and have none.
2. Of each SPREAD windows in a row (fewer in a short text) the one of least rank, the first of equals, gets a vote. Windows with
   SPREAD / VOTED votes are features; where none has so many, those that have the most.
3. A text's features, each once and in order, go into Bloom filters of FILTER_BITS bits, HASHES bits each; after FEATURES features
   the next filter of the chain begins. The fingerprint is the number of features and the filters in base64.
4. Two filters are as alike as the bits that they share beyond chance, by the most that they could. For each filter of the shorter
   chain the most alike one of the other counts, weighted by its bits. Equal fingerprints have likeness 1.

Entropies come from the counts of the byte that leaves and of the byte that enters when the window moves, in whole numbers, so equal
windows have equal entropies wherever they stand, and equal texts equal fingerprints under one table of ranks.

Texts shorter than a window, or of nothing but windows without a rank, are one feature as a whole; null and empty texts have none,
and are alike to each other only. Rows that repeat give a row each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.shared import row_key, table
from cartulary.llm.words import mix

WINDOW = 64
SPREAD = 64
#: A feature has the votes of at least one in so many of the rows of windows that hold it.
VOTED = 4
#: Shorter texts have shorter rows, the largest power of two with which this many fit side by side.
ROWS = 16
FEATURES = 160
FILTER_BITS = 2048
HASHES = 5
#: Entropies are counted in so many steps; below LEAST of them a window has no rank.
STEPS = 1000
LEAST = 100
#: Texts are handled in groups of about so many bytes, which stay in a core's cache.
GROUP_BYTES = 1 << 17
#: Bytes of filters compared at a time.
COMPARED = 1 << 25

_UNIT = 1 << 20
_SUM = np.array([round(_UNIT * c * np.log2(c)) if c else 0 for c in range(WINDOW + 1)], np.int64)
_STEP = np.append(0, np.diff(_SUM))  # what a byte adds that is there for the c-th time
_NO_RANK = STEPS + 1
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def entropies(data: np.ndarray) -> np.ndarray:
    """Of each window of the bytes: its entropy in steps, rounded down."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    kind = np.int32 if n < 1 << 22 else np.int64
    order = np.argsort(data, kind="stable").astype(kind)
    key = data[order].astype(kind) * kind(n + WINDOW) + order  # places by byte, far from those of other bytes
    at = np.arange(n)
    ahead = np.searchsorted(key, key + kind(WINDOW - 1), side="right") - at  # how often the byte stands in the window that it begins
    earlier = np.cumsum(np.bincount(at + ahead - 1, minlength=n))  # places whose window does not reach the next one
    leaves, enters = np.empty(n, np.int64), np.empty(n, np.int64)
    leaves[order] = _STEP[ahead]
    enters[order] = _STEP[at + 1 - np.append(0, earlier[:-1])]
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = _SUM[np.bincount(data[:WINDOW])].sum()
    np.cumsum(enters[WINDOW:] - leaves[: n - WINDOW], out=sums[1:])
    sums[1:] += sums[0]
    most = _SUM[WINDOW]
    return np.maximum(most - sums, 0) * STEPS // most


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of some columns, the first of them the text, in groups of about GROUP_BYTES."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            held.append((row[0] or "", *row[1:]))
            size += len(held[-1][0])
            if size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(STEPS + 1, np.int64)
    for rows in _grouped(batches, ["text"]):
        texts = [t.encode() for (t,) in rows]
        sizes = np.array([len(t) for t in texts])
        step = entropies(np.frombuffer(b"".join(texts), np.uint8))
        inside = np.ones(len(step) + WINDOW, bool)  # windows of one text
        for end in np.cumsum(sizes).tolist():
            inside[max(0, end - WINDOW + 1) : end] = False
        total += np.bincount(step[inside[: len(step)]], minlength=STEPS + 1)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["step", "n"])


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step: steps that fewer of the corpus's windows have come first, those below LEAST have none."""
    counts = docs.select("text").mapInArrow(_count_steps, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()  # a row a step at most
    n = np.zeros(STEPS + 1, np.int64)
    for r in counts:
        n[r.step] = r.n
    ranks = np.empty(STEPS + 1, np.int64)
    ranks[np.argsort(n, kind="stable")] = np.arange(STEPS + 1)
    ranks[:LEAST] = _NO_RANK
    return ranks


def select_features(ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the features. ranks: of all windows, text after text; sizes: windows of each text."""
    n, out = len(ranks), []
    if not n:
        return np.zeros(0, np.int64)
    bits = max(int(n - 1).bit_length(), 1)
    kind = np.uint32 if bits + _NO_RANK.bit_length() <= 32 else np.uint64
    least = (ranks.astype(kind) << kind(bits)) | np.arange(n, dtype=kind)  # the least is the first of the least ranks
    start = np.cumsum(sizes) - sizes
    level = np.minimum(np.log2(np.maximum(sizes // ROWS, 1)).astype(np.int64), SPREAD.bit_length() - 1)
    for k in range(SPREAD.bit_length()):
        of = np.flatnonzero((level == k) & (sizes > 0))
        count = sizes[of] - (1 << k) + 1
        out.append(least[np.repeat(start[of] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))])
        if len(least) <= 1 << k:
            break
        least = np.minimum(least[: -(1 << k)], least[1 << k :])
    voted = np.concatenate(out)
    voted = voted[(voted >> kind(bits)) != _NO_RANK] & kind((1 << bits) - 1)
    votes = np.bincount(voted.astype(np.int64), minlength=n)
    some = np.flatnonzero(sizes)
    need = np.zeros(len(sizes), np.int64)
    need[some] = np.clip(np.maximum.reduceat(votes, start[some]), 1, np.maximum((1 << level[some]) // VOTED, 1))
    return np.flatnonzero(votes >= np.repeat(need, sizes))


def filter_chains(texts: list[bytes], data: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's Bloom filters (rows of bytes) and number of features. places: of features in data; first: where texts start."""
    rows = data[places[:, None] + np.arange(WINDOW)].view(np.uint64)
    h = np.zeros(len(places), np.uint64)
    for j in range(WINDOW // 8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j] + np.uint64(1))
    text = np.searchsorted(first, places, side="right") - 1
    has = np.zeros(len(texts), bool)
    has[text] = True
    alone = [i for i, t in enumerate(texts) if t and not has[i]]
    text = np.append(text, alone).astype(np.int64)
    h = np.append(h, np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in alone], np.uint64))
    order = np.lexsort((h, text))  # each once; lexsort is stable, so the first of equals is the first in the text
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1])
    keep = np.sort(order[new])
    keep = keep[np.argsort(text[keep], kind="stable")]
    text, h = text[keep], h[keep]
    n = np.bincount(text, minlength=len(texts))
    filters = -(-n // FEATURES)
    base = np.cumsum(filters) - filters
    of = base[text] + (np.arange(len(text)) - (np.cumsum(n) - n)[text]) // FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    width = FILTER_BITS.bit_length() - 1
    for j in range(HASHES):
        bits[of, ((h >> np.uint64(j * width)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + f] for b, f in zip(base.tolist(), filters.tolist(), strict=True)], n


def encoded(chain: np.ndarray, n: int) -> str:
    return f"{n}:{base64.b64encode(chain.tobytes()).decode()}"


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def chain_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two chains of filters, 0 to 1, the same both ways."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    m, n = (np.bitwise_count(x.view(np.uint64)).sum(axis=1).astype(np.float64) for x in (a, b))
    scores = np.empty((len(a), len(b)))
    step = max(1, COMPARED // b.nbytes)
    for lo in range(0, len(a), step):
        both = a[lo : lo + step].view(np.uint64)[:, None] & b.view(np.uint64)[None]
        scores[lo : lo + step] = np.bitwise_count(both).sum(axis=2)
    chance = np.outer(m, n) / FILTER_BITS
    chance += 3 * np.sqrt(chance * np.outer(1 - m / FILTER_BITS, 1 - n / FILTER_BITS))  # three deviations more
    most = np.minimum.outer(m, n)
    scores = np.clip((scores - chance) / np.maximum(most - chance, 1e-9), 0, 1) * (most > chance)
    one = float(scores.max(axis=1) @ m / m.sum())
    return min(one, float(scores.max(axis=0) @ n / n.sum())) if len(a) == len(b) else one


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return 1.0 if a == b else chain_likeness(decoded(a), decoded(b))


def chains(texts: list[bytes], ranks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Filters and numbers of features of some texts."""
    data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return _chains(texts, data, first, ranks[entropies(data)])


def _chains(texts: list[bytes], data: np.ndarray, first: np.ndarray, rank: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """rank: of the window at each place of data; those at texts' ends are passed over."""
    sizes = np.maximum(np.diff(first) - WINDOW + 1, 0)
    place = np.repeat(first[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return filter_chains(texts, data, first, place[select_features(rank[place], sizes)])


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """A row per document: doc_id, fingerprint. ranks: from entropy_ranks, of this corpus or of the one to compare with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["text", "doc_id"]):
            found, n = chains([t.encode() for t, _ in rows], ranks)
            yield pa.record_batch([pa.array([i for _, i in rows], pa.int64()), pa.array([encoded(c, k) for c, k in zip(found, n.tolist(), strict=True)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, fingerprint string")


def _edited(texts: list[str], nexts: list[str], ranks: np.ndarray) -> pa.RecordBatch:
    """Rows but doc_id of texts, each with the one after it. nexts[:-1] is texts[1:]; only the last is another one."""
    own = [t.encode() for t in [*texts, nexts[-1]]]
    data = np.frombuffer(b"".join(own) or b"\0", np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
    rank = ranks[entropies(data)]
    found, n = _chains(own, data, first, rank)
    # Windows of an edited text are the document's, the next one's, and those across the seam, which alone are new.
    heads = [t[: len(t) - len(t) // 2].encode() for t in texts]
    tails = [x[: len(t) // 2].encode() for t, x in zip(texts, nexts, strict=True)]
    seams = [h[len(h) - min(len(h), WINDOW - 1) :] + t[: WINDOW - 1] for h, t in zip(heads, tails, strict=True)]
    seam_first = np.concatenate([[0], np.cumsum([len(s) for s in seams])]).astype(np.int64)
    seam_rank = ranks[entropies(np.frombuffer(b"".join(seams) or b"\0", np.uint8))]
    parts = []
    for i, (h, t, s) in enumerate(zip(heads, tails, seams, strict=True)):
        parts += [
            rank[first[i] : first[i] + max(len(h) - WINDOW + 1, 0)], seam_rank[seam_first[i] : seam_first[i] + max(len(s) - WINDOW + 1, 0)],
            rank[first[i + 1] : first[i + 1] + max(len(t) - WINDOW + 1, 0)],
        ]
    edited = [h + t for h, t in zip(heads, tails, strict=True)]
    edited_data = np.frombuffer(b"".join(edited) or b"\0", np.uint8)
    edited_first = np.concatenate([[0], np.cumsum([len(t) for t in edited])]).astype(np.int64)
    sizes = np.maximum(np.diff(edited_first) - WINDOW + 1, 0)
    place = np.repeat(edited_first[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    chosen = place[select_features(np.concatenate(parts), sizes)]
    changed, k = filter_chains(edited, edited_data, edited_first, chosen)
    return pa.record_batch([
        pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
        pa.array([encoded(c, m) for c, m in zip(found[:-1], n[:-1].tolist(), strict=True)], pa.string()), pa.array([encoded(c, m) for c, m in zip(changed, k.tolist(), strict=True)], pa.string()),
        pa.array([chain_likeness(a, b) for a, b in zip(found[:-1], changed, strict=True)], pa.float64()), pa.array([chain_likeness(a, b) for a, b in zip(found[:-1], found[1:], strict=True)], pa.float64()),
    ], names=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _with_id(ids: list, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids, pa.int64()), *rows.columns], names=["doc_id", *rows.schema.names])


def _compare_with_next(ranks: np.ndarray):
    """Rows come in order; all but the partition's last have their next one here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for rows in _grouped(batches, ["text", "doc_id"]):
            rows = last + rows
            if len(rows) > 1:
                yield _with_id([i for _, i in rows[:-1]], _edited([t for t, _ in rows[:-1]], [t for t, _ in rows[1:]], ranks))
            last = rows[-1:]

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's first text, and its last row."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first = b.slice(0, 1) if first is None else first
            last = b.slice(b.num_rows - 1)
    if first is not None:
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), first.column("text"), last.column("doc_id"), last.column("text")], names=["part", "first_text", "doc_id", "text"])


def _compare_pairs(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                yield _with_id([i], _edited([text or ""], [after or ""], ranks))

    return run


def compared_with_next(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text (the last half of its code points replaced by as many from the start of the next document, or all), and the likeness to that and to the next document.

    The next document is that with the next greater doc_id (nulls come first, rows with one doc_id by a hash of their text), after
    the last the first. Documents are sorted over range partitions, by one shuffle that all that follows reads; only a partition's last document
    meets its next one, the first of the next partition, by a window over one row a partition.
    """
    if docs.sparkSession.conf.get("spark.sql.exchange.reuse") != "true":  # ranges of two shuffles differ
        raise ValueError("compared_with_next needs spark.sql.exchange.reuse, Spark's default")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text", row_key().alias("row")).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    inner = ordered.mapInArrow(_compare_with_next(ranks), _SCHEMA)
    ends = ordered.mapInArrow(_ends, "part int, first_text string, doc_id long, text string")
    by_part = Window.orderBy("part")
    first = F.first("first_text").over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    seams = ends.withColumn("next_text", F.coalesce(F.lead(F.coalesce("first_text", F.lit(""))).over(by_part), first))
    return inner.union(seams.select("doc_id", "text", "next_text").mapInArrow(_compare_pairs(ranks), _SCHEMA))


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract query: every whole document of `documents` compared with its edited text and with the next document."""
    docs = table(spark, sf_dir, "documents")
    return compared_with_next(docs, entropy_ranks(docs))
