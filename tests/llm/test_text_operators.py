import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.llm import decontaminate, host_rules, line_dedup, minhash, stages, substring_dedup
from cartulary.llm.words import Words, kgrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall(text or "")


def sorted_rows(df, *columns):
    return sorted(([tuple(r) for r in df.select(*columns).collect()]), key=repr)


# --- words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\r é", max_size=12)), max_size=6))
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    flat = [x.encode() for t in texts for x in split(t)]
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == flat
    assert np.diff(w.first).tolist() == [len(split(t)) for t in texts]
    by_hash = dict(zip(w.hash.tolist(), flat, strict=True))
    assert len(by_hash) == len(set(flat)) and all(by_hash[h] == x for h, x in zip(w.hash.tolist(), flat, strict=True))
    grams = kgrams(w.hash, 2).tolist()
    assert len(set(grams)) == len({*zip(flat, flat[1:], strict=False)})


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_hashes_of_long_words():
    """Words that any polynomial modulo 2**64 confuses, and words that differ by a byte, its place or their length."""
    some = [thue_morse(n, *x) for n in (1024, 2048, 4096) for x in ("ab", "ba", "AB", "BA")]
    some += ["x" * n for n in range(1, 40)] + ["x" * i + "y" + "x" * (30 - i) for i in range(31)] + ["z\0", "z", "\0z", "\0" * 8, "\0" * 9]
    w = Words(pa.array([" ".join(some), *some]))
    assert w.hash[: len(some)].tolist() == w.hash[len(some) :].tolist() and len(set(w.hash.tolist())) == len(some)


# --- op2


def brute_spans(corpus, window):
    counts = Counter()
    for _, text, *_ in corpus:
        w = split(text)
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc, text, *_ in corpus:
        w = split(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "words"), [(substring_dedup.ANCHOR_STRETCHES, substring_dedup.BLOCK_WORDS), (1, 40)])
def test_substring_dedup(docs, corpus, monkeypatch, most, words):
    monkeypatch.setattr(substring_dedup, "ANCHOR_STRETCHES", most)  # 1: all anchors with different stretches are anchored again, down to windows
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", words)
    assert sorted_rows(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_text") == brute_spans(corpus, 35)


def test_a_frequent_anchor_with_many_stretches(spark, monkeypatch):
    """One shingle in all texts, in ever other surroundings, some of which are shared."""
    monkeypatch.setattr(substring_dedup, "ANCHOR_STRETCHES", 20)
    rng = np.random.default_rng(3)
    fill = lambda n: [f"x{rng.integers(10**6)}" for _ in range(n)]
    common, left, right = ["the", "very", "same", "eight", "words", "in", "each", "text"] * 2, [fill(30) for _ in range(12)], [fill(30) for _ in range(12)]
    corpus = [(d, " ".join([*fill(5), *left[rng.integers(12)][int(rng.integers(25)) :], *common, *right[rng.integers(12)][: int(rng.integers(30))], *fill(5)])) for d in range(300)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert sorted_rows(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_text") == brute_spans(corpus, 35)


def test_substring_dedup_of_words_alike(spark):
    """Two texts that differ only by a word that a polynomial modulo 2**64 doesn't tell from the other's share no window that has it."""
    rng = np.random.default_rng(8)
    rest = [f"x{rng.integers(10**6)}" for _ in range(60)]
    corpus = [(d, " ".join([*rest[:20], thue_morse(2048, *x), *rest[20:]])) for d, x in enumerate(("ab", "ba"))]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert sorted_rows(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_text") == brute_spans(corpus, 35)


def test_substring_dedup_odd(empty, wide, corpus):
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert sorted_rows(substring_dedup.substring_dedup(wide), "doc_id", "n_words", "n_removed", "kept_text") == brute_spans(corpus, 35)


BLOCKS = st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=5)


def flat(texts):
    return np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])


def best_match(texts, t, i):
    """Words that place i of text t has in common with its best other place."""
    return max((next((k for k in range(len(texts[t]) - i + 1) if k == len(texts[t]) - i or k == len(x) - j or texts[t][i + k] != x[j + k]), 0) for u, x in enumerate(texts) for j in range(len(x)) if (u, j) != (t, i)), default=0)


@settings(max_examples=80, deadline=None)
@given(BLOCKS)
def test_the_parse_takes_the_longest_factors(texts):
    words, first = flat(texts)
    match = substring_dedup.longest_matches(words, first)
    assert match.tolist() == [best_match(texts, t, i) for t in range(len(texts)) for i in range(len(texts[t]))]
    expected = []
    for t, x in enumerate(texts):
        i = 0
        while i < len(x):
            n = max(1, best_match(texts, t, i))
            expected.append((int(first[t]) + i, n))
            i += n
    assert list(zip(*(x.tolist() for x in substring_dedup.factors(match, first)), strict=True)) == expected


@settings(max_examples=80, deadline=None)
@given(BLOCKS)
def test_parse_finds_all_repeated_windows(texts):
    window = 4
    counts = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    found = defaultdict(set)
    for t, lo, hi in zip(*(x.tolist() for x in substring_dedup.duplicate_runs(*flat(texts), window)), strict=True):
        assert 0 <= lo < hi <= len(texts[t])
        found[t] |= set(range(lo, hi))
    for i, t in enumerate(texts):
        assert found[i] == {k + j for k in range(len(t) - window + 1) if counts[tuple(t[k : k + window])] > 1 for j in range(window)}


# --- op6


def brute_sets(corpus, n):
    out = []
    for _, text, *_ in corpus:
        w = split((text or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def brute_groups(corpus, n, percent=80):
    sets = brute_sets(corpus, n)
    low = lambda d: minhash.NO_ID if d is None else d
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(sets)):
        least[find(i)].append(low(corpus[i][0]))
    out = []
    for i, s in enumerate(sets):
        c = min(least[find(i)])
        out.append((corpus[i][0], len(s), None if c == minhash.NO_ID else c, c == low(corpus[i][0])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, corpus, n):
    assert sorted_rows(minhash.near_duplicates(docs, n), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(corpus, n)


def test_near_duplicates_odd(empty, wide, corpus):
    assert minhash.near_duplicates(empty).count() == 0
    assert sorted_rows(minhash.near_duplicates(wide, 2), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(corpus, 2)


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """Variants of one text, many of which are similar to others only through a third: the star alone would lose links."""
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 40)
    rng = np.random.default_rng(2)
    base, corpus = [f"b{i}" for i in range(120)], []
    for d in range(150):
        w = list(base)
        for k in rng.choice(120, size=int(rng.integers(3, 11)), replace=False):
            w[k] = f"e{rng.integers(4)}"
        corpus.append((d, " ".join(w), "en", "s"))
    docs = spark.createDataFrame([(d, t) for d, t, *_ in corpus], "doc_id long, text string")
    assert sorted_rows(minhash.near_duplicates(docs, 2), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(corpus, 2)


def test_near_duplicates_without_or_with_shared_ids(spark, tmp_path):
    """Null ids: one of each group is kept. A shared id: one text's group says nothing of the other's."""
    rng = np.random.default_rng(4)
    base = [[f"{k}x{i}" for i in range(200)] for k in range(4)]
    near = lambda k: " ".join([*base[k][: (at := int(rng.integers(10, 200)))], "edit", *base[k][at + 1 :]])
    groups = {}
    rows = [(None, near(0)) for _ in range(6)] + [(None, near(1)) for _ in range(6)] + [(9, near(1)), (None, " ".join(base[3])), (None, " ".join(base[3]))]
    rows += [(3, near(2)), (5, near(2)), (5, "unlike all of the other texts " * 9), (6, near(2)), (7, "One two"), (7, "one two")]
    for d, t in rows:
        groups.setdefault(t.split(" ")[3][0] if len(t) > 10 else "one", []).append((d, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stages.near_duplicate(spark, docs, str(tmp_path)).count() == len(groups)
    hashed = {r.row: r.text for r in docs.select(F.xxhash64("text").alias("row"), "text").collect()}
    out = [(r.doc_id, hashed[r.row], r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect()]
    assert len(out) == len(rows)
    for members in groups.values():
        found = [x for x in out if x[:2] in members]
        assert len({x[:2] for x in found if x[3]}) == 1  # rows that repeat count as one
        ids = [d for d, _ in members]
        assert {x[2] for x in found} == {None if None in ids else min(ids)} == {x[0] for x in found if x[3]}


def test_near_duplicates_contract_of_shared_and_missing_ids(spark, tmp_path):
    """kept is doc_id = component_id, also where a doc_id repeats with another text or is null: rows as SQL has them."""
    duckdb = pytest.importorskip("duckdb")
    base = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join([*base, "more"])), (9, " ".join(["less", *base])), (None, "other words of its own"), (3, "other words of its own"), (4, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = minhash.op6_near_duplicates(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == sorted(duck.execute(minhash.OP6_SQL).fetchall(), key=repr)


def test_sets_of_long_texts(monkeypatch):
    text = "".join(f"w{i % 977} é{i}\n" for i in range(3000))
    for n in (1, 2, 5):
        want = minhash.shingle_sets(pa.array([text]), n)[0]
        monkeypatch.setattr(minhash, "CHUNK_BYTES", 500)
        assert np.array_equal(minhash.shingle_sets(pa.array([text]), n)[0], want)
        monkeypatch.undo()


def test_blocks_of_a_family_are_cut_by_shingles(spark, monkeypatch):
    """Long members: blocks of few rows, and no link is lost."""
    monkeypatch.setattr(minhash, "FAMILY_SHINGLES", 500)
    rng = np.random.default_rng(5)
    base, corpus = [f"b{i}" for i in range(120)], []
    for d in range(60):
        w = list(base)
        for k in rng.choice(120, size=int(rng.integers(3, 11)), replace=False):
            w[k] = f"e{rng.integers(4)}"
        corpus.append((d, " ".join(w), "en", "s"))
    docs = spark.createDataFrame([(d, t) for d, t, *_ in corpus], "doc_id long, text string")
    assert sorted_rows(minhash.near_duplicates(docs, 2), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(corpus, 2)


def test_signatures_estimate_the_similarity():
    rng, orders = np.random.default_rng(1), minhash._orders()
    for n in (5, 40, 2000):
        agree = []
        for _ in range(30):
            u = np.unique(rng.integers(0, 2**64, size=n, dtype=np.uint64))
            k = max(1, n // 5)
            v = np.unique(np.concatenate([u[k:] if n > 5 else u[1:], rng.integers(0, 2**64, size=1, dtype=np.uint64)]))
            j = len(np.intersect1d(u, v)) / len(np.union1d(u, v))
            agree.append((minhash.signature(u, orders) == minhash.signature(v, orders)).mean() - j)
        assert abs(np.mean(agree)) < 0.06


# --- op9


def brute_rules(text):
    text = text or ""
    w = split(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_host_rules(docs, corpus, wide, empty):
    expected = sorted(((d, *brute_rules(t)) for d, t, *_ in corpus), key=repr)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = host_rules.host_rules(docs)
    assert sorted_rows(out, *columns) == expected
    assert sorted_rows(host_rules.host_rules(wide), *columns) == expected
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)
    assert host_rules.host_rules(empty).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "x" if i % 10 else text, "bad") for i in range(300)] + [(1000 + 50 * h + i, text if i else "x", f"good{h}") for h in range(12) for i in range(50)]
    rows += [(5000, "x", "tiny"), (5001, text, "tiny"), (5002, text, None)]
    out = {r.doc_id: r for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].host_rejected and not out[0].base_failed and not out[0].kept
    assert not out[5001].host_rejected and out[5001].kept  # one failure of two says little
    assert out[1001].kept and not out[1000].kept and out[5002].kept


# --- op10


def brute_lines(corpus, min_chars=20, min_docs=3):
    low = lambda d: minhash.NO_ID if d is None else d
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for d, text, *_ in corpus:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(low(d))
    out = []
    for d, text, *_ in corpus:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == low(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def applied(docs):
    return sorted_rows(line_dedup.line_dedup(docs).mapInArrow(line_dedup._applied, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"), "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_line_dedup(docs, wide, corpus, empty):
    assert applied(docs) == brute_lines(corpus)
    assert applied(wide) == brute_lines(corpus)
    assert applied(empty) == []


def test_lines_of_documents_without_an_id_as_sql_has_them(spark, tmp_path):
    """A null doc_id is a document, and the smallest."""
    duckdb = pytest.importorskip("duckdb")
    line = "a line of more than twenty characters"
    rows = [(None, f"{line}\nown"), (1, f"x\n{line}"), (2, line.upper()), (None, f"{line}\nother"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = line_dedup.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found), key=repr) == sorted(duck.execute(line_dedup.OP10_SQL).fetchall(), key=repr)
    assert sum(r.n_dropped for r in found) == 3


def test_a_line_of_all_documents(spark):
    """One key over all partitions: only their edges decide."""
    corpus = [(d, f"the same long line in all of them\nown {d}\n" + "another line that two have in common\n" * (d < 2), "en", "s") for d in range(500)]
    rows = spark.createDataFrame([(d, t) for d, t, *_ in corpus], "doc_id long, text string")
    assert applied(rows) == brute_lines(corpus)


# --- op3


def test_templates(spark):
    def of(text):
        row = spark.createDataFrame([(text,)], "text string").select(decontaminate.template(decontaminate.tokens(F.col("text"))).alias("t")).first()
        return ["N" if x == decontaminate.NAME else x for x in row.t]

    assert of("Then Anna bought 3.5 kg of Ripe apples, Bob 12.") == ["then", "N", "bought", "#", "%", "of", "N", "apples", "N", "#"]
    assert of("kg 5 min") == ["kg", "#", "%"]
    assert of(None) == [] and of("") == [] and of("… !") == []


ITEMS = [(1, "A train leaves the station at 9 hours and Anna waits while Bob counts 9 wagons and 12 passengers on the platform."), (2, "short one"), (3, None), (None, "this item has no identifier but has enough words to be looked for in documents"), (4, "every word of this plain item without any numbers is looked for as it stands here")]


def found(spark, text):
    rows = spark.createDataFrame([(7, text)], "doc_id long, text string")
    r = decontaminate.decontaminate(rows, spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    return list(r["items"]), r.exact


def test_benchmark_items_are_found(spark):
    literal = ITEMS[0][1]
    other = literal.replace("Anna", "Carla").replace("Bob", "Dora").replace("9", "7").replace("12", "30")
    assert found(spark, f"some words before. {literal} and after") == ([1], True)
    assert found(spark, f"some words before. {other} and after") == ([1], False)
    assert found(spark, literal.replace("9 wagons", "8 wagons"))[0] == []  # 9 stands for two values
    assert found(spark, "well, " + ITEMS[4][1].upper() + "!") == ([4], True)
    assert found(spark, "\n".join(ITEMS[4][1].split(" "))) == ([4], True)
    assert found(spark, " ".join(ITEMS[4][1].split(" ")[:14])) == ([4], True)  # thirteen tokens and more
    assert found(spark, " ".join(ITEMS[4][1].split(" ")[:10])) == ([], False)
    assert found(spark, "short one") == ([], False)


def brute_found(item, text):
    """Whether the windows of eight equal tokens on some alignment cover thirteen tokens."""
    of = lambda t: ["#" if x[0].isdigit() else x.lower() for x in re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_][^\W_]*", t or "")]
    a, b = of(item), of(text)
    covered = defaultdict(set)
    places = defaultdict(list)
    for i in range(len(a) - 7):
        places[tuple(a[i : i + 8])].append(i)
    for j in range(len(b) - 7):
        for i in places.get(tuple(b[j : j + 8]), ()):
            covered[j - i].update(range(i, i + 8))
    return any(len(c) >= 13 for c in covered.values())


def test_decontamination_odd(spark, docs, wide, empty, corpus):
    passage = docs.filter("doc_id = 90").first().text
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = decontaminate.decontaminate(docs, items)
    assert sorted_rows(out, "doc_id", "contaminated") == sorted(((d, brute_found(passage, t)) for d, t, *_ in corpus), key=repr)
    assert out.filter("contaminated").count() > 10
    clean = decontaminate.clean(wide, items)
    assert clean.columns == wide.columns and clean.count() == out.filter("not contaminated").count()
    assert decontaminate.decontaminate(empty, items).count() == 0
    none = items.limit(0)
    assert decontaminate.decontaminate(docs, none).filter("contaminated").count() == 0


SHORT = [
    (1, "What is the boiling point of 12 34 56"),  # windows at the end have too few words
    (2, "Which planet of the system is largest by mass"),  # its first word is a name inside a text
    (3, "Name the largest ocean"),  # shorter than a window
    (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19"),  # no words at all
    (5, "Meters are what we count on this long road"),  # its first word is a unit after a number
]


def test_short_items_are_found_when_copied(spark):
    items = spark.createDataFrame(SHORT, "item_id long, text string")
    texts = [f"some words, {t} and more" for _, t in SHORT] + [f"Question: {t}" for _, t in SHORT] + [f"{t}" for _, t in SHORT] + [f"of 7 {SHORT[4][1]}"]
    other = [
        "Question: Whose planet of the system is largest by mass",  # another first word
        "name the largest sea and then the ocean", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 20", "name the largest", "what is the boiling point",
    ]
    rows = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string")
    out = {r.doc_id: (list(r["items"]), r.exact) for r in decontaminate.decontaminate(rows, items).collect()}
    assert [out[i] for i in range(len(texts))] == [([k], True) for k in (1, 2, 3, 4, 5) * 3] + [([5], True)]
    assert [out[len(texts) + i] for i in range(len(other))] == [([], False)] * len(other)


def test_short_items_with_other_numbers(spark):
    """Items without windows are found by their template, with consistent slots; those of one or two tokens word for word, and apart."""
    texts = [(1, "What is 23 times 47 minus 12"), (2, "Photosynthesis process"), (3, "Entropy"), (4, "How far is 5 km from 5 miles"), (5, "3 4 5 6"), (6, "Alice owes Bob 7 old coins and Bob 9")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    rows = [
        "What is 91 times 33 minus 70", "So: what is 8 times 8 minus 8?", "What was 91 times 33 minus 70", "About the photosynthesis process in plants", "photosynthesis as a process", "entropy grows", "How far is 8 km from 8 miles",
        "How far is 8 km from 9 miles", "3 4 5 7", "then 3 4 5 6", "Carol owes Dan 8 old coins and Dan 1", "Carol owes Dan 8 old coins and Eve 1", "ALICE OWES BOB 7 OLD COINS AND BOB 9", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: (r.contaminated, list(r["items"]), r.exact, list(r.short_items)) for r in decontaminate.decontaminate(docs, items).collect()}
    clean = (False, [], False, [])
    assert out == {
        0: (True, [1], False, []), 1: (True, [1], False, []), 2: clean, 3: (False, [], False, [2]), 4: clean, 5: (False, [], False, [3]), 6: (True, [4], False, []), 7: clean, 8: clean, 9: (True, [5], True, []),
        10: (True, [6], False, []), 11: clean, 12: (True, [6], True, []), 13: clean, 14: clean,
    }
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [2, 3, 4, 5, 7, 8, 11, 13, 14]


def test_many_items_of_one_short_template(spark):
    """A document meets a template once, not once an item; all items of the class are named."""
    items = spark.createDataFrame([(i, f"What is {i} plus {i + 1} as number") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "What is 1000 plus 2 as number"), (1, "what is 7 plus 8 as number"), (2, "what is seven plus eight")], "doc_id long, text string")
    keyed = docs.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("row"), "text")
    assert decontaminate.whole_items(keyed, decontaminate.benchmark_items(items)).count() <= 3
    out = {r.doc_id: (len(r["items"]), r.exact) for r in decontaminate.decontaminate(docs, items).collect()}
    assert out == {0: (300, False), 1: (300, True), 2: (0, False)}


def test_items_without_an_id_or_with_a_shared_one(spark):
    texts = [(None, "nobody gave this passage any number but it has plenty of words"), (None, "two words only differ"), (8, "the first of two passages that go by one and the same number"), (8, "quite another passage under that number with other words in it")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(4, "clean")], "doc_id long, text string")
    out = {r.doc_id: (r.contaminated, list(r["items"]), r.exact) for r in decontaminate.decontaminate(rows, items).collect()}
    assert out == {0: (True, [], True), 1: (True, [], True), 2: (True, [8], True), 3: (True, [8], True), 4: (False, [], False)}
    assert [r.doc_id for r in decontaminate.clean(rows, items).collect()] == [4]


def test_digits_of_any_script_and_names_at_a_sentence_start(spark):
    texts = [(1, "\u0661\u0662 apples and \u0663 pears lie in the large basket on our table today"), (2, "Alice buys 3 apples and sells 2 pears today at the old market square"), (3, "Every apple in the large basket was sold to somebody on the market today")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    rows = [
        "\u0664 apples and \u0665\u0665 pears lie in the large basket on our table today", "7 apples and 8 pears lie in the large basket on our table today",
        "Bob buys 5 apples and sells 4 pears today at the old market square", "So Bob buys 5 apples and sells 4 pears today at the old market square", "Bob buys 5 apples and sells 4 plums today at the old market place",
        "ALICE BUYS 3 APPLES AND SELLS 2 PEARS TODAY AT THE OLD MARKET SQUARE", "alice buys 3 apples and sells 2 pears today at the old market square",
        "each apple in the large basket was sold to somebody on the street today or not", "Some apple in the",
    ]
    out = decontaminate.decontaminate(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), items)
    assert [(list(r["items"]), r.exact) for r in out.orderBy("doc_id").collect()] == [([1], False), ([1], False), ([2], False), ([2], False), ([], False), ([2], True), ([2], True), ([], False), ([], False)]


NAME_OR_NOT = regex.compile(r"\p{Nd}+(?:[.,:/]\p{Nd}+)*|\p{L}[\p{L}\p{M}\p{Nd}]*")


def kinds(text):
    """(kind, lower-cased token) of each token."""
    out = []
    for m in NAME_OR_NOT.finditer(text):
        word, before = m[0], text[: m.start()]
        if word[0].isdecimal():
            kind = "#"
        elif word[0].isupper() and (regex.search(r"[\p{Ll},;:] $", before) or (regex.match(r"\p{Lu}\p{Ll}", word) and word.lower() not in decontaminate.STARTERS)):
            kind = "N"
        else:
            kind = "%" if out and out[-1][0] == "#" and word.lower() in decontaminate.UNITS else word.lower()
        out.append((kind, word.lower()))
    return out


def brute_items(items, text):
    """Ids found, and whether one of them word for word, by trying all alignments."""
    doc, found, exact = kinds(text), set(), False
    for key, item_text in items:
        item = kinds(item_text)
        small = kinds(item_text.lower())
        good = [p for p in range(len(item) - 7) if sum(k not in ("#", "%", "N") for k, _ in item[p : p + 8]) >= 5]
        size = lambda at: len({p + i for p in at for i in range(8)})
        for shift in range(-len(item), len(doc)):
            at = []
            for p in good:
                window = doc[p + shift : p + shift + 8] if p + shift >= 0 else []
                if len(window) < 8:
                    continue
                for form in (item, small):
                    own = [k for k, _ in form[p : p + 8]]
                    same = own == [k for k, _ in window]
                    if p == 0 and item[0][0] != "#" and window[0][1] == item[0][1]:
                        same = same or own[1:] == [k for k, _ in window[1:]]  # the first word may be a name, a unit or neither
                    if same and p not in at:
                        at.append(p)
            pairs = {(item[p + i][1], doc[p + i + shift][1]) for p in at for i in range(8)}
            if at and size(at) >= min(13, size(good)) and len(pairs) == len({a for a, _ in pairs}):
                found.add(key)
                exact = exact or all(a == b for a, b in pairs)
    return sorted(found), exact


def test_templates_against_brute_force(spark):
    rng = random.Random(11)
    names, units = ["Anna", "Bob", "Carla", "Dora"], ["kg", "hours", "miles"]

    def sentence():
        pool = lambda: rng.choices([rng.choice(["walks", "sees", "the", "green", "over", "house", "and", "tells", "old", "river"]), rng.choice(names), f"{rng.randrange(1, 9)} {rng.choice(units)}", str(rng.randrange(1, 9))], [8, 2, 1, 1])[0]
        return " ".join([rng.choice(["The", "What", *names]), *(pool() for _ in range(rng.randrange(9, 20)))]) + "."

    items = [(i, sentence() + (" " + sentence() if i % 3 == 0 else "")) for i in range(12)]
    items += [(20 + i, items[i][1].replace("Anna", "Bob").replace("3", "4")) for i in range(4)]  # classes of several items, some equal
    changes = [lambda t: t, str.lower, str.upper, lambda t: t.replace("Anna", "Eva").replace("Bob", "Fritz"), lambda t: regex.sub(r"\d", lambda _: str(rng.randrange(10, 99)), t), lambda t: t.replace("5", "61").replace("7", "8"), lambda t: " ".join(t.split(" ")[:14]), lambda t: " ".join(t.split(" ")[1:])]
    texts = [rng.choice(["", "so ", "Then it is: ", "weighs 3 ", sentence() + " "]) + change(t) + " " + sentence() for _, t in items for change in changes]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.decontaminate(rows, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert (list(r["items"]), r.exact) == brute_items(items, t), t
    assert 60 < sum(r.contaminated for r in out) < len(texts) and any(len(r["items"]) > 1 for r in out)
