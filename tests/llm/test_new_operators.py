"""op11 to op13: digests, hard negatives and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.llm import digests, hard_negatives, runs
from cartulary.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- op11


def windows(data, ranks):
    """Rank of each window of bytes, straight from its entropy."""
    out = []
    for i in range(len(data) - digests.WINDOW + 1):
        w = data[i : i + digests.WINDOW]
        total = sum(round((1 << 20) * c * np.log2(c)) for c in (w.count(x) for x in set(w)))
        most = round((1 << 20) * digests.WINDOW * np.log2(digests.WINDOW))
        out.append(int(ranks[(most - total) * digests.STEPS // most]))
    return out


def brute_features(data, ranks):
    """Features by voting over all rows of windows."""
    found = windows(data, ranks)
    m = len(found)
    if not m:
        return [data] if data else []
    spread = 1 << min(int(math.log2(max(m // digests.ROWS, 1))), 6)
    votes = [0] * m
    for lo in range(m - spread + 1):
        least = min(range(lo, lo + spread), key=lambda i: (found[i], i))
        votes[least] += found[least] != digests._NO_RANK
    need = min(max(*votes, 1), max(spread // digests.VOTED, 1)) if m > 1 else 1
    chosen = [data[i : i + digests.WINDOW] for i in range(m) if votes[i] >= need]
    return list(dict.fromkeys(chosen)) or [data]


def text(rng, n):
    return "".join(rng.choice("abcdefgh ijkl\né") for _ in range(n))


def test_entropies_and_features():
    rng = random.Random(3)
    ranks = np.random.default_rng(1).permutation(digests.STEPS + 1)
    ranks[: digests.LEAST] = digests._NO_RANK
    texts = [text(rng, rng.choice([0, 1, 40, 63, 64, 65, 130, 400, 1500, 4000])).encode() for _ in range(40)]
    texts += [b"a" * 500, b"a" * 200 + texts[-1] + b"b" * 70, texts[0], b"x" * 64]
    assert all([int(x) for x in ranks[digests.entropies(np.frombuffer(t, np.uint8))]] == windows(t, ranks) for t in texts)
    found, n = digests.chains(texts, ranks)
    for t, chain, k in zip(texts, found, n.tolist(), strict=True):
        own = brute_features(t, ranks)
        assert (k, len(chain)) == (len(own), -(-len(own) // digests.FEATURES))
        one, m = digests.chains([t], ranks)  # a text's fingerprint doesn't depend on those around it
        assert digests.encoded(one[0], m[0]) == digests.encoded(chain, k) and np.array_equal(digests.decoded(digests.encoded(chain, k)), chain)


def brute_likeness(a, b):
    bits = lambda c: [{i for i, x in enumerate(np.unpackbits(row)) if x} for row in c]
    x, y = sorted((bits(a), bits(b)), key=len)
    if not x or not y:
        return float(not x and not y)

    def alike(p, q):
        chance = len(p) * len(q) / digests.FILTER_BITS
        chance += 3 * math.sqrt(chance * (1 - len(p) / digests.FILTER_BITS) * (1 - len(q) / digests.FILTER_BITS))
        most = min(len(p), len(q))
        return max(0.0, (len(p & q) - chance) / (most - chance)) if most > chance else 0.0

    one = lambda x, y: sum(len(p) * max(alike(p, q) for q in y) for p in x) / sum(map(len, x))
    return min(one(x, y), one(y, x)) if len(x) == len(y) else one(x, y)


def test_likeness():
    rng = random.Random(5)
    ranks = np.arange(digests.STEPS + 1)
    texts = [text(rng, n) for n in (0, 10, 300, 3000, 30000)]
    texts += [texts[3][:1500] + texts[4][:1500], texts[4][:20000] + text(rng, 15000)]
    found, n = digests.chains([t.encode() for t in texts], ranks)
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            got = digests.chain_likeness(a, b)
            assert got == pytest.approx(1.0 if i == j else brute_likeness(a, b), abs=1e-9) and got == digests.chain_likeness(b, a)
            assert got == digests.likeness(digests.encoded(a, n[i]), digests.encoded(b, n[j])) and 0 <= got <= 1
    assert digests.chain_likeness(found[3], found[5]) > 0.3 and digests.chain_likeness(found[3], found[2]) < 0.05
    assert digests.chain_likeness(found[4], found[6]) > 0.4


def test_compared_with_next(spark, docs, wide, empty, corpus):
    """Every row once, with its own next document, over more ranges than rows and over one; also null and repeated rows."""
    ranks = digests.entropy_ranks(docs)
    hashed = {t: h for t, h in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((d, t) for d, t, *_ in corpus), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    texts = [t or "" for _, t in order]
    expected = []
    for (d, _), a, b in zip(order, texts, [*texts[1:], texts[0]], strict=True):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        f = [digests.encoded(c, k) for c, k in zip(*(x for x in digests.chains([x.encode() for x in (a, edited, b)], ranks)), strict=True)]
        expected.append((d, len(a), hashlib.sha256(edited.encode()).hexdigest(), f[0], f[1], digests.likeness(f[0], f[1]), digests.likeness(f[0], f[2])))
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert rows_of(digests.compared_with_next(docs, ranks), *columns) == sorted(expected, key=repr)
    assert rows_of(digests.compared_with_next(wide, ranks), *columns) == sorted(expected, key=repr)
    assert rows_of(digests.fingerprints(docs, ranks), "doc_id", "fingerprint") == sorted(((x[0], x[3]) for x in expected), key=repr)
    assert digests.compared_with_next(empty, digests.entropy_ranks(empty)).count() == 0
    one = spark.createDataFrame([(4, "only one text")], "doc_id long, text string")
    row = digests.compared_with_next(one, digests.entropy_ranks(one)).first()
    assert (row.near_next, row.n_chars, row.edited_sha256) == (1.0, 13, hashlib.sha256(("only one text"[:7] + "only one text"[:6]).encode()).hexdigest())


def test_ranks_are_of_all_windows(docs, corpus):
    counts = np.zeros(digests.STEPS + 1, np.int64)
    for _, t, *_ in corpus:
        data = np.frombuffer((t or "").encode(), np.uint8)
        counts += np.bincount(digests.entropies(data), minlength=digests.STEPS + 1)
    ranks = digests.entropy_ranks(docs)
    kept = np.arange(digests.LEAST, digests.STEPS + 1)
    assert list(kept[np.argsort(ranks[kept])]) == sorted(kept, key=lambda s: (counts[s], s)) and (ranks[: digests.LEAST] == digests._NO_RANK).all()


# --- op12


def brute_negatives(rows, every=100):
    fine = {(i, (l + 1) % 10 if i % 7 == 0 else l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    for a in fine:
        if a[0] % every:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b) for b in fine if b != a), key=lambda s: s[:2])
        for p in [s for s in scored if s[2][1] == a[1]][:5]:
            fits = [s for s in scored if s[2][1] != a[1] and -80 * p[0] <= -100 * s[0] <= -100 * p[0]]
            out += [(a[0], p[1], i + 1, s[1], -p[0], -s[0]) for i, s in enumerate(fits[:5])]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cls string, n int")


@pytest.mark.parametrize("first", [4096, 8])
def test_hard_negatives(spark, monkeypatch, first):
    """Small blocks and a first round of few vectors: the search goes on until the bound certifies; a third of all rows are one vector."""
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", first)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "SLICE", 3)
    rng = np.random.default_rng(7)
    near = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in (near[i % 6] + 0.3 * rng.normal(size=8)) / 4], int(rng.integers(4))) for i in range(1, 260)]
    rows += [(i * 50, [0.25] * 8, 2) for i in range(6, 60)] + [(3001 + i, [0.25] * 8, 1) for i in range(40)] + [(4000, [0.0] * 8, 1), (4100, [-0.1] * 8, 2), (5000, [9.0] * 8, 3)]
    rows += [rows[0], rows[300], (None, [0.1] * 8, 1), (6000, None, 1), (6100, [float("nan")] * 8, 1), (6200, [float("inf")] * 8, 1), (6300, [None] * 8, 1), (6400, [0.2] * 8, None)]
    got = hard_negatives.hard_negatives(hard_negatives.labelled_rows(vectors(spark, rows)))
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute_negatives(rows)


def test_hard_negatives_odd(spark):
    none = vectors(spark, [(1, [0.5], 1)]).limit(0)
    assert hard_negatives.hard_negatives(hard_negatives.labelled_rows(none)).count() == 0
    few = [(100, [0.5, 0.5], 1), (200, [0.5, 0.5], 1), (3, [0.5], 2), (4, [0.5, 0.25], 2), (5, [], 2)]
    got = hard_negatives.hard_negatives(hard_negatives.labelled_rows(vectors(spark, few)))
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute_negatives(few)


def test_large_numbers_stay_exact():
    """Beyond 53 bits scores are taken in whole numbers."""
    index = object.__new__(hard_negatives.Index)
    index.dims, index.kind, index.exact = 2, "<i8", False
    q = np.array([[1 << 30, 1]], np.int64)
    x = np.array([[1 << 30, 1], [1 << 30, 2]], np.int64)
    targets = pa.array([[{"hi": hard_negatives.ANY, "bound": -hard_negatives.ANY}]], pa.list_(pa.struct([("hi", pa.int64()), ("bound", pa.int64())])))
    queries = pa.StructArray.from_arrays([pa.array([1], pa.int64()), pa.array([1], pa.int32()), pa.array([q[0].tobytes()], pa.binary()), targets], names=["q", "q_label", "q_vec", "targets"])
    batch = pa.record_batch([
        pa.ListArray.from_arrays(pa.array([0, 1], pa.int32()), queries), pa.array([[7, 8]], pa.list_(pa.int64())), pa.array([[1, 1]], pa.list_(pa.int32())), pa.array([[[70], [80]]], pa.list_(pa.list_(pa.int64()))),
        pa.array([[v.tobytes() for v in x]], pa.list_(pa.binary())),
    ], names=["queries", "cls", "label", "ids", "vecs"])
    found = next(index._scan(True, 2)(iter([batch]))).to_pydict()
    assert (found["id"], found["score"]) == ([80, 70], [(1 << 60) + 2, (1 << 60) + 1])


# --- op13


def brute_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


repeats = st.builds(lambda w, k, tail, more: (w * k)[: len(w) * k - min(tail, len(w) - 1)] + more, st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7), st.integers(0, 8), st.lists(st.integers(0, 2), max_size=9))


@settings(max_examples=150)
@given(st.lists(st.lists(repeats, max_size=4).map(lambda x: sum(x, [])), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
def test_all_runs_are_found(texts, least):
    flat = mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(9))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = runs.text_runs(flat, first, least)
    assert [found.get(i, []) for i in range(len(texts))] == [brute_runs(t, least) for t in texts]


def test_blocks_and_previous_factors():
    words = [1, 2, 1, 2, 1, 3, 1, 2, 1, 2]
    first = np.array([0, 6, 10])
    suffixes, levels = runs.rank_levels(np.array(words, np.uint64), first)
    length, source = runs.previous_factors(suffixes, levels)
    assert length == [0, 0, 3, 2, 1, 0, 0, 0, 2, 1]  # of each text alone
    assert source[2] == 0 and source[8] == 6
    assert runs.blocks(length, first.tolist()) == [[0, 1, 2, 5, 6], [6, 7, 8, 10]]


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 12)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_periodic_runs_query(spark, tmp_path, corpus):
    rng = random.Random(2)
    rows = [(d, t) for d, t, *_ in corpus if len(WORD.findall(t or "")) < 3000]  # brute force takes the square
    for i in range(100, 180):
        rows.append((i, " \t".join(rng.choice(["a", "b", "lorem", "ipsum"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 150)))))
    rows += [(-7, "x " * 1500), (None, "y z " * 40), (3, "\n".join(f"w{i % 700}" for i in range(1700)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, words string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.op13_periodic_runs(spark, str(tmp_path))
    assert rows_of(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == sorted((brute_row(*r) for r in rows), key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0
