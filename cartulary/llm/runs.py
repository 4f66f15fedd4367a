"""Periodic run detection: all maximal repetitions of a text's words, from its longest previous factors.

A run is a stretch of words with smallest period q and a length of `min_words` and 2q or more that no neighbouring word extends.
From a run's start + q on, at least min_words / 2 of its words stand q words earlier too, so texts in which no so many consecutive
words repeat have none; all others are searched, side by side in one set of arrays:

1. suffix array by prefix doubling; the ranks of all places by their next 1, 2, 4, ... words are kept, and tell how far two places
   agree onwards or backwards in as many steps as there are levels;
2. the common prefixes of neighbours in the suffix array give each place's longest previous factor, with the places unlinked from
   the last to the first;
3. longest previous factors give the Lempel-Ziv blocks;
4. a run that crosses or touches the start b of a block has, by Main's theorem, a period of at most the two blocks' words and
   holds [b, b+q) or [b-q, b) whole: the agreements of b with b+q and of b-q with b, both ways, give its ends;
5. a run strictly inside a block stands in the block's earlier occurrence too. Runs are bucketed by start and copied from there,
   block by block.

A text is searched in one task, in arrays of some 640 bytes a word (ranks at every level); nothing is shuffled. Words are compared
by 64-bit hashes. Null and empty texts have no words and no runs. Rows that repeat give a row each.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import WORD, table
from cartulary.llm.words import Words, chunks, kgrams, mix

#: Pairs of places that are compared at a time.
PAIRS = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, kept_text string"


def rank_levels(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the texts (one after the other), and ranks of all places by their next 2**k words inside the text.

    Equal ranks mean equal words; a text's end comes before any word. Each array of ranks has a last entry for the end of all.
    Only places whose rank isn't theirs alone are sorted again.
    """
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][text] - np.arange(n)
    key = np.unique(words, return_inverse=True)[1] + text * np.int64(n + 1)
    suffixes = np.argsort(key, kind="stable")

    def starts(sorted_keys: np.ndarray) -> np.ndarray:
        """For each place of a sorted array the index of the first equal one."""
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return np.flatnonzero(new)[np.cumsum(new) - 1]

    rank = np.full(n + 1, -1, np.int32)
    rank[suffixes] = starts(key[suffixes])
    levels, span = [rank], 1
    slots = np.arange(n)
    while True:
        at = rank[suffixes[slots]]
        several = np.zeros(len(at), bool)
        several[1:] = at[1:] == at[:-1]
        several[:-1] |= several[1:]
        slots = slots[several]  # where ranks are shared
        if not len(slots):
            return suffixes, levels
        places = suffixes[slots]
        after = np.where(left[places] > span, rank[np.minimum(places + span, n)].astype(np.int64) + 1, 0)
        key = rank[places].astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        suffixes[slots] = places[order]
        rank = rank.copy()
        rank[places[order]] = slots[starts(key[order])]
        levels.append(rank)
        span *= 2


def agree_after(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that the texts from places x and y have in common (x differs from y)."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][x + out] == levels[k][y + out]).astype(np.int64) << k
    return out


def agree_before(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Words before places x and y > x that agree; start: the first place of their text."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        to = x - out - (1 << k)
        same = (to >= start) & (levels[k][np.maximum(to, 0)] == levels[k][np.maximum(y - out - (1 << k), 0)])
        out += same.astype(np.int64) << k
    return out


def previous_factors(suffixes: np.ndarray, levels: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor from there that also starts before it in the text, and a place where it does.

    Of the places up to i, those next to i in the order of suffixes agree most with it: places are taken from the last to the
    first and unlinked, and two that become neighbours agree in the lesser of what each had with the one between.
    """
    n = len(suffixes)
    common = np.zeros(n + 1, np.int64)  # of a suffix and the one before it in order
    common[1:n] = agree_after(levels, suffixes[:-1], suffixes[1:])
    slot = np.empty(n, np.int64)
    slot[suffixes] = np.arange(n)
    padded = np.concatenate([[n], suffixes, [n]])
    before, after = np.append(padded[slot], n).tolist(), np.append(padded[slot + 2], n).tolist()
    up, down = np.append(common[slot], 0).tolist(), np.append(common[slot + 1], 0).tolist()
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        a, b, x, y = before[i], after[i], up[i], down[i]
        if x >= y:
            length[i], source[i] = x, a
            least = y
        else:
            length[i], source[i] = y, b
            least = x
        after[a] = b
        before[b] = a
        down[a] = least
        up[b] = least
    return length, source


def blocks(length: list[int], first: list[int]) -> list[list[int]]:
    """Starts of each text's Lempel-Ziv blocks, with the text's end."""
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        at, i = [], lo
        while i < hi:
            at.append(i)
            i += length[i] or 1
        out.append([*at, hi])
    return out


def crossing_runs(words: np.ndarray, levels: list[np.ndarray], cuts: list[list[int]], min_words: int) -> np.ndarray:
    """(start, length, period) of the runs that cross or touch a block's start or end, each once."""
    b = np.concatenate([np.asarray(c[1:], np.int64) for c in cuts])
    most = np.concatenate([np.diff(np.asarray([*c, c[-1]], np.int64)) for c in cuts])  # words of the blocks, 0 for a text's end
    width = np.concatenate([np.diff(np.asarray(c, np.int64)) for c in cuts])
    ends = np.cumsum([len(c) - 1 for c in cuts])
    most = np.delete(most, np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]]))  # of the block that starts at b
    lo = np.repeat([c[0] for c in cuts], np.diff(ends, prepend=0))
    hi = np.repeat([c[-1] for c in cuts], np.diff(ends, prepend=0))
    most = width + most
    found = [np.zeros((0, 3), np.int64)]
    words = np.append(words, words[:1])
    slices = np.searchsorted(np.cumsum(most), np.arange(0, int(most.sum()), PAIRS), side="left") if len(most) else []
    for i, j in zip(slices, [*slices[1:], len(most)], strict=True):
        of = np.repeat(np.arange(i, j), most[i:j])
        q = np.arange(len(of)) - np.repeat(np.cumsum(most[i:j]) - most[i:j], most[i:j]) + 1
        for x, ok in ((b[of], b[of] + q <= hi[of]), (b[of] - q, b[of] - q >= lo[of])):
            x, p, s, e = x[ok], q[ok], lo[of[ok]], hi[of[ok]]
            y = x + p
            near = ((words[x] == words[y]) & (y < e)) | ((x > s) & (words[x - 1] == words[y - 1]))
            x, y, p, s = x[near], y[near], p[near], s[near]
            back = agree_before(levels, x, y, s)
            both = back + agree_after(levels, x, y)
            run = (both >= p) & (both + p >= min_words)
            found.append(np.column_stack([x[run] - back[run], (both + p)[run], p[run]]))
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
    return out[new]  # multiples of the period span the same words


def copied_runs(runs: list[tuple[int, int, int]], cuts: list[int], source: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """All runs of a text: those given, and those that lie strictly inside a block, by start."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for s, n, q in runs:
        bucket.setdefault(s, []).append((n, q))
    starts = sorted(bucket)
    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e - b < min_words + 2 or not starts:
            continue
        src = source[b]
        move, end = b - src, src + e - b
        todo = starts[bisect_right(starts, src) : bisect_left(starts, end)]  # sorted, so a heap; grows where a block overlaps its source
        while todo:
            s = heappop(todo)
            to = bucket.get(s + move, [])
            new = [(n, q) for n, q in bucket[s] if s + n < end and (n, q) not in to]
            if not new:
                continue
            if not to:
                insort(starts, s + move)
                if s + move < end:
                    heappush(todo, s + move)
            bucket[s + move] = to + new
    return [(s, n, q) for s in starts for n, q in sorted(bucket[s], key=lambda x: x[1])]


def text_runs(words: np.ndarray, first: np.ndarray, min_words: int) -> dict[int, list[tuple[int, int, int]]]:
    """By text: its runs (start in the text, length, period) by start, then period. words: hashes, text after text; first: where each starts, and the end."""
    k = -(-min_words // 2)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = kgrams(words, k)
    inside = np.flatnonzero(text[: len(grams)] == text[k - 1 :])
    key = grams[inside] ^ mix(text[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    twice = np.unique(text[inside[order[1:][key[order[1:]] == key[order[:-1]]]]])
    if not len(twice):
        return {}
    sizes = np.diff(first)[twice]
    own = np.concatenate([[0], np.cumsum(sizes)])
    words = words[np.repeat(first[twice] - own[:-1], sizes) + np.arange(own[-1])]
    suffixes, levels = rank_levels(words, own)
    length, source = previous_factors(suffixes, levels)
    cuts = blocks(length, own.tolist())
    found = crossing_runs(words, levels, cuts, min_words)
    out = {}
    at = np.searchsorted(found[:, 0], own)
    for i, t in enumerate(twice.tolist()):
        if at[i + 1] > at[i]:
            lo = int(own[i])
            runs = copied_runs([tuple(x) for x in found[at[i] : at[i + 1]].tolist()], cuts[i], source, min_words)
            out[t] = [(s - lo, n, q) for s, n, q in runs]
    return out


def _run_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch):
                w = Words(t.column("text"))
                found = text_runs(w.hash, w.first, min_words)
                kept = []
                for i, text in enumerate(t.column("text")):
                    words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                    if i in found:
                        edge = np.zeros(len(words) + 1, np.int64)
                        s, n, q = np.array(found[i]).T
                        np.add.at(edge, s + q, 1)
                        np.add.at(edge, s + n, -1)
                        words = [words[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                    kept.append(b" ".join(words))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, [])] for i in range(len(t))]
                yield pa.record_batch([t.column("doc_id"), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "kept_text"])

    return run


def periodic_runs(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """A row per document: doc_id, runs (start, length, period; by start, then period), kept_text: the words that no run holds beyond its first period, with one space between."""
    return docs.select("doc_id", "text").mapInArrow(_run_rows(min_words), _SCHEMA)


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of each tenth document, by crc32 of its id, the words from the g % n-th on are made periodic. A null id's text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    g, n = F.floor(h / 10), F.size("words")
    parts = docs.select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn("a", F.when(n > 0, F.col("g") % n))
    parts = parts.withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.col("g") % 8 + 3)))
    i = lambda x: F.when(x < F.col("a"), x).otherwise(F.col("a") + (x - F.col("a")) % F.col("p")).cast("int")
    periodic = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.get("words", i(x))), " ")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: the runs of every whole document of `documents`, a tenth of which are made periodic; the longest run's place, and hashes of all runs and of the collapsed text."""
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.p")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


#: crc32 bit by bit (its polynomial is the constant), then the six-word sequences that stand q words apart, joined into stretches.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT rid, doc_id, ws, len(ws) AS n, flatten([[(ascii(c) >> k) & 1 FOR k IN range(0, 8)] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]) AS bits FROM d),
h AS (SELECT rid, doc_id, ws, n, xor(list_reduce(list_concat([4294967295::BIGINT], bits), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM b),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
t AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(0, n)] END AS w FROM p),
s AS (SELECT rid, unnest(range(0, n - 5)) AS i, w FROM t WHERE n >= 6),
k AS (SELECT rid, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS k FROM s),
m AS (SELECT x.rid, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.rid = y.rid AND x.k = y.k AND x.i < y.i),
o AS (SELECT rid, i, q, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m),
v AS (SELECT rid, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM o GROUP BY rid, q, island),
r AS (SELECT rid, start, length, min(q) AS period FROM v WHERE length >= 12 AND length >= 2 * q GROUP BY rid, start, length),
u AS (SELECT rid, count(*) AS n_runs, min({'n': -length, 's': start, 'p': period}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.n AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
  CAST((-1000 * best.n) // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN u USING (rid) LEFT JOIN (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS c FROM (SELECT rid, unnest(w) AS word, unnest(range(0, n)) AS i FROM t) ANTI JOIN x USING (rid, i) GROUP BY rid) USING (rid)
"""
