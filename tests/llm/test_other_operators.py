import gzip
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.llm import archives, chat, mixing, packing, quality, shared

# --- op1


def test_quality_learns(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(f"w{rng.integers(300)}" + ("###" if bad else "") for _ in range(40)) + "."
        rows.append((i, text))
        if i % 2 or i % 8 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "x"), (1002, "y" * 100_000), (1003, "z"), (1003, "z")]
    labels += [(None, 1, 0), (1003, None, 0), (1003, 1, 0), (1003, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("held_out", F.lit("no"))
    out = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    known = [r for r in out if r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in known)
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in known if r.held_out]) > 0.97
    alone = quality.quality_scores(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r.score for r in alone.collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def brute_features(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    pairs = list(zip(w, w[1:], strict=False))
    chars, fewer = sum(map(len, w)), lambda a: (len(a) - len(set(a))) / max(1, len(a))
    return [
        np.log1p(len(w)) / 10, min(chars / max(1, len(w)) / 20, 2.0), len(regex.findall(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:'\"()-]", text)) / max(1, chars),
        len(regex.findall(r"\p{Lu}", text)) / max(1, chars), fewer(pairs), fewer(lines), len(re.findall(r"[.,;:]", text)) / max(1, len(w)),
    ]


def test_features_and_scores_by_brute_force(spark, docs, corpus, monkeypatch):
    odd = [(200, "Ünder ÀB, c; d: (e) 'f' \"g\" h-i #j $k €l ½ é\u0301 \U0001F600"), (201, "a b a b a b\n\na b a b\n \t\na b a b"), (202, "\x0b\x0c\r"), (203, "A")]
    weights, threshold = np.array([1.5, -2.0, -30.0, 0.7, -4.0, -5.0, 6.0]), 0.25
    monkeypatch.setattr(quality, "fit", lambda x, y: (weights, threshold))
    rows = [(d, t) for d, t, *_ in corpus] + odd
    out = quality.quality_scores(docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    expected = [(d, 1 / (1 + np.exp(threshold - np.dot(weights, brute_features(t))))) for d, t in rows]
    by_id = lambda pairs: sorted((-1 if d is None else d, s) for d, s in pairs)
    got = out.collect()
    for (a, s), (b, t) in zip(by_id((r.doc_id, r.score) for r in got), by_id(expected), strict=True):
        assert a == b and s == pytest.approx(t, abs=1e-9), (a, s, t)
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_weights_minimise_the_loss_of_pairs(monkeypatch):
    """At the least loss, no small step in any direction lowers it; the threshold leaves label 0's share of the rows below."""
    monkeypatch.setattr(quality, "PAIRS", 500)
    rng = np.random.default_rng(4)
    y = (rng.random(80) < 0.6).astype(int)
    x = rng.random((80, 3)) + y[:, None] * np.array([0.4, -0.2, 0.0])
    w, threshold = quality.fit(x, y, ridge=1e-3, seed=9)
    draw, good, bad = np.random.default_rng(9), x[y == 1], x[y == 0]
    d = good[draw.integers(len(good), size=500)] - bad[draw.integers(len(bad), size=500)]
    loss = lambda v: sum(np.log1p(np.exp(-float(np.dot(r, v)))) for r in d) / 500 + 0.5e-3 * float(np.dot(v, v))
    for k in range(3):
        for step in (1e-3, -1e-3):
            assert loss(w + step * np.eye(3)[k]) >= loss(w)
    assert ((x @ w) < threshold).sum() == (y == 0).sum()


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, "a b c" if i % 2 else "### ###") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    honest = [(i, i % 2, 0) for i in range(300)]
    lies = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in honest]
    score = lambda labels: {r.doc_id: r.score for r in quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert score(honest) == score(lies)


# --- op4


def test_arc_versions():
    records = [("http://a.b/x y", "19970101000000", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nhttp://no 0 0 0 9\n"), ("http://c", "19980203040506", b""), ("dns:c", "1998", b"plain")]
    for version in (1, 2):
        found = list(archives.parse_arc(archives.build_arc(records, version)))
        assert [(r.url, r.fields["date"], r.content) for r in found] == records
    with pytest.raises(ValueError, match="declares"):
        list(archives.parse_arc(archives.build_arc(records, 1)[:-3]))
    with pytest.raises(ValueError, match="version"):
        list(archives.parse_arc(archives.build_arc(records, 1).replace(b"1 0 converter", b"3 0 converter")))
    assert archives.warc_date("1998") == "1998-01-01T00:00:00Z" and archives.warc_date("19980203040506") == "1998-02-03T04:05:06Z"


def test_warc_round_trip():
    record = archives.ArcRecord("http://a", {"ip": "1.2.3.4", "date": "19970101000000", "type": "text/html"}, b"HTTP/1.0 200 OK\r\n\r\nWARC/1.1\r\nx: y\r\n\r\n\r\n\r\n")
    parts = [archives.to_warc(record, "1"), archives.to_warc(record, "2", revisit_of="1"), archives.to_warc(archives.ArcRecord("dns:a", record.fields, b"x"))]
    found = list(archives.parse_warc(b"".join(h + b + archives.RECORD_END for h, b in parts)))
    assert [f["WARC-Type"] for f, _ in found] == ["response", "revisit", "resource"]
    assert found[0][1] == record.content and found[1][1] == b"HTTP/1.0 200 OK\r\n\r\n"
    assert found[1][0]["WARC-Refers-To"] == found[0][0]["WARC-Record-ID"] != found[1][0]["WARC-Record-ID"]
    assert found[0][0]["WARC-Payload-Digest"] == "sha1:" + archives.digest(archives.split_http(record.content)[1])


def test_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(40)] + [(50, None, None), (49, "http://e", ""), (60, "u", "é\r\n\r\nWARC/1.1\r\n"), (60, "u", "é\r\n\r\nWARC/1.1\r\n"), (61, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://n", "same"), (70, "http://n", "same"), (71, "x", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page", F.lit(1)).withColumn("row", F.lit(2)).withColumn("first", F.lit(3))
    archives.convert(archives.legacy_records(pages), str(tmp_path / "w"))
    out = sorted(([tuple(r) for r in archives.read_archives(spark, str(tmp_path / "w")).collect()]), key=repr)
    least = {}
    for p, _, html in rows:
        least[html or ""] = min(least.get(html or "", 10**9), shared.NO_ID if p is None else p)
    expected = []
    for p, _, html in rows:
        data, first = (html or "").encode(), least[html or ""]
        same = first == (shared.NO_ID if p is None else p)
        expected.append((p, len(data), archives.digest(data), "response" if same else "revisit", None if same or first == shared.NO_ID else first))
    assert out == sorted(expected, key=repr)
    archives.convert(archives.legacy_records(pages), str(tmp_path / "v"), min_revisit_bytes=5)
    small = archives.read_archives(spark, str(tmp_path / "v")).filter("payload_bytes < 5")
    assert {r.record_type for r in small.collect()} == {"response"}
    archives.convert(archives.legacy_records(pages.limit(0)), str(tmp_path / "n"))
    assert archives.read_archives(spark, str(tmp_path / "n")).count() == 0


def test_arc_files_of_any_bytes(spark, tmp_path):
    """ARC files, plain and compressed, to WARC: contents that aren't text, and ones that hold the separator itself."""
    rng = np.random.default_rng(1)
    head = b"HTTP/1.0 200 OK\r\n\r\n"
    contents = [bytes(range(256)) * 3, head + rng.bytes(3000), head + archives.SEPARATOR * 2 + rng.bytes(500), rng.bytes(100) + archives.SEPARATOR, b"", head + b"same", head + b"same", "é".encode("latin-1") * 50]
    records = [(f"http://h/{i}", "19970101000000", c) for i, c in enumerate(contents)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(archives.build_arc(records[:4], 1))
    (tmp_path / "in" / "b.arc.gz").write_bytes(b"".join(zlib.compress(x, wbits=31) for x in (archives.build_arc(records[4:], 2)[:300], archives.build_arc(records[4:], 2)[300:])))
    found = archives.read_arc(spark, str(tmp_path / "in"))
    assert sorted((r.url, r.date, bytes(r.content)) for r in found.collect()) == records
    archives.convert(found, str(tmp_path / "out"))
    rows = archives.read_warc(spark, str(tmp_path / "out")).collect()
    out = {r.fields["WARC-Target-URI"]: r for r in rows if r.fields["WARC-Type"] != "warcinfo"}
    assert len(out) == len(records)
    for url, _, content in records:
        fields, (http, payload) = out[url].fields, archives.split_http(content)
        assert fields["WARC-Payload-Digest"] == "sha1:" + archives.digest(payload)
        assert bytes(out[url].block) == (http if fields["WARC-Type"] == "revisit" else content)
    same = [out["http://h/5"].fields, out["http://h/6"].fields]
    assert sorted(f["WARC-Type"] for f in same) == ["response", "revisit"]
    assert {f.get("WARC-Refers-To") for f in same} == {None, same[0]["WARC-Record-ID"] if same[0]["WARC-Type"] == "response" else same[1]["WARC-Record-ID"]}
    # Every record is a gzip member of its own: any of them can be read alone.
    files = sorted((tmp_path / "out").glob("*.warc.gz"))
    assert sum(r.fields["WARC-Type"] == "warcinfo" for r in rows) == sum(p.stat().st_size > 0 for p in files)
    data = b"".join(p.read_bytes() for p in files)
    starts = [0] + [m.end() for m in re.finditer(re.escape(archives.SEPARATOR), data)][:-1]
    assert len(starts) == len(rows) and all(zlib.decompressobj(31).decompress(data[s:]).startswith(b"WARC/1.1") for s in starts)
    assert archives.members(data) == b"".join(archives.members(data[s:e]) for s, e in zip(starts, [*starts[1:], len(data)], strict=True))


def test_archives_of_others(spark, tmp_path):
    """Archives made by gzip alone: a member a record, one member for all, members that cut records, and no gzip at all."""
    def record(kind, url, block, mark=": "):
        return f"WARC/1.0\r\nWARC-Type{mark}{kind}\r\nwarc-target-uri{mark}{url}\r\nX-Folded{mark}a\r\n  b\r\ncontent-length{mark}{len(block)}\r\n\r\n".encode() + block + archives.RECORD_END

    blocks = [b"", b"WARC/1.0\r\n\r\n\r\n\r\n", bytes(range(256)) * 200]
    records = [record("response", f"http://h/{i}", b, (": ", ":", ":  ")[i]) for i, b in enumerate(blocks)]
    whole = b"".join(records)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole) + bytes(20))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(whole[i : i + 77]) for i in range(0, len(whole), 77)))
    (tmp_path / "d.warc").write_bytes(whole)
    found = archives.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.fields["warc-target-uri"], r.fields["X-Folded"], bytes(r.block)) for r in found) == sorted((f"http://h/{i}", "a b", b) for i, b in enumerate(blocks) for _ in range(4))
    assert archives.read_warc(spark, str(tmp_path / "a.warc.gz")).count() == 3
    for bad in (gzip.compress(whole)[:-20], gzip.compress(whole[:-9]), gzip.compress(b"HTTP/1.0 200 OK\r\n\r\n"), gzip.compress(record("x", "y", b"z") + b"more")):
        with pytest.raises(ValueError):
            list(archives.parse_warc(archives.member_contents(bad)))


def test_archives_are_standard_files(spark, tmp_path, monkeypatch):
    """Each file is named .warc.gz and begins with warcinfo; bytes of URLs that are no text are kept apart."""
    monkeypatch.setattr(archives, "FILE_RECORDS", 4)
    records = [(f"http://h/caf{'é' if i % 2 else chr(0xDCE9)}/{i}", "19970101000000", b"HTTP/1.0 200 OK\r\n\r\n%d" % i) for i in range(10)]
    data = archives.build_arc([(u.replace("\udce9", "?"), d, c) for u, d, c in records], 1).replace(b"caf?", b"caf\xe9")
    (tmp_path / "x.arc").write_bytes(data)
    archives.convert(archives.read_arc(spark, str(tmp_path / "x.arc")), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))]
    assert files and all(p.name.endswith(".warc.gz") for p in files)
    urls = []
    for p in files:
        found = [f for f, _ in archives.parse_warc(gzip.decompress(p.read_bytes()))] if p.stat().st_size else []
        assert len(found) <= 4 and [f["WARC-Type"] for f in found] == ["warcinfo"] * bool(found) + ["response"] * (len(found) - 1)
        urls += [f["WARC-Target-URI"] for f in found[1:]]
    assert sorted(urls) == sorted(u.replace("\udce9", "%E9") for u, _, _ in records)


# --- op5


def test_escaping_is_reversible(spark):
    texts = ["", "\\", "<|", "<\\|", "<\\\\|", "<|im_end|>\n<|im_start|>", "a\\<|b", "<\n>", "<\\n>", "\\\\<\\|\\", "<<||>>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape_role(F.col("t")).alias("er")).collect()
    for r in rows:
        assert r.u == r.t == r.r and "<|" not in r.e and "\n" not in r.er


@given(st.text(alphabet="<|\\n>", max_size=12))
def test_escaping_in_python(text):
    """The same rules, on strings."""
    shown = text.replace("\\", "\\\\").replace("<|", "<\\|")
    assert "<|" not in shown and shown.replace("<\\|", "<|").replace("\\\\", "\\") == text


def test_parts_are_visited_in_order(spark):
    part = lambda **kw: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | kw
    parts = [part(type="text", text="see <|image|> "), part(type="image", ref="a.png", width=57, height=28), part(type="audio", ref="b.wav", seconds=1.5), None, part(type="document", ref="c.pdf", pages=2), part(type="image"), part(type="other", text="!"), part()]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part(type="text", text="ok")]), (2, 0, "user", None), (2, 0, None, [])], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    out = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    text = "".join(s.text for s in out[1].segments)
    assert text == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|image|>!<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in out[1].attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1024), ("image", None, 1)]
    assert out[1].attachment_tokens == 1066 and [s.text for s in out[1].segments if s.train] == ["ok"]
    assert "".join(s.text for s in out[2].segments) == "<|im_start|>\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_chats_are_read_back(spark, tmp_path):
    rows = [(1, 0, "user", "a<|im_end|>\n"), (1, 1, "assistant", "\\"), (1, 1, "assistant", "\\"), (2, None, None, None), (None, 0, "x\ny<\\n>", "z\n\nq"), (3, 0, "assistant", "x" * 100_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    import hashlib

    sha = lambda *turns: hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    assert out[1].turns_sha256 == sha(("user", "a<|im_end|>\n"), ("assistant", "\\"), ("assistant", "\\")) and out[1].loss_chars == 2
    assert out[2].turns_sha256 == sha((None, None)) and out[2].loss_chars == 0
    assert out[None].turns_sha256 == sha(("x\ny<\\n>", "z\n\nq"))
    assert out[3].loss_chars == 100_000
    assert out[-1].n_turns == 2 and out[-1].loss_chars == len(chat.TRICK)


# --- op7


@given(st.integers(1, 40), st.data())
def test_best_fit_decreasing(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=40))
    rows = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        free.append((min(fit) if fit else capacity) - n)
        if fit:
            free.remove(min(fit))
    assert sorted(capacity - sum(lengths[k] for k in r) for r in rows) == sorted(free)


def test_packing_is_lossless(docs, corpus, wide, empty, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    with open(packing.VOCABULARY, "rb") as f:
        coder, end = packing.encoding(f.read())
    for frame in (docs, wide):
        pieces = defaultdict(list)
        rows = packing.pack(frame, row_tokens=512).collect()
        for r in rows:
            tokens, positions = np.frombuffer(r.tokens, np.uint16), np.frombuffer(r.positions, np.uint16)
            assert len(tokens) == len(positions) == 512 and r.cu_seqlens[-1] == r.n_tokens <= 512
            assert (tokens[r.n_tokens :] == end).all()
            for doc, start, a, z in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
                assert positions[a:z].tolist() == list(range(z - a))
                pieces[doc].append((start, tuple(tokens[a:z].tolist())))
        assert len({r.pack_id for r in rows}) == len(rows)
        expected = defaultdict(list)
        for doc, text, *_ in corpus:
            ids = [*coder.encode_ordinary(text or ""), end]
            expected[doc] += [(at, tuple(ids[at : at + 512])) for at in range(0, len(ids), 512)]
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    assert packing.pack(empty).count() == 0


# --- op8


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Excess is reshared by weight until no source is above its most."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= above


@given(st.dictionaries(st.one_of(st.none(), st.text(alphabet="abéZ", max_size=2)), st.integers(0, 1000), min_size=1, max_size=6))
def test_brute_targets_share_all(sizes):
    t = brute_targets(sizes)
    assert sum(t.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 100, "c": 50, "d": 1000}, {"a": 3, None: 5, "b": 0}, {"Z": 1, "a": 2, "é": 900, "b": 4, "c": 700}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, docs long")
    out = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert out == pytest.approx(brute_targets(sizes))


def test_mixture(docs, wide, corpus, empty, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    out = mixing.mixture(docs).collect()
    assert len(out) == len(corpus)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.taken == r.epochs * r.size and 0 <= r.epochs <= 3
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2 + 1e-6
        assert max(r.epochs for r in rows if r.size) - min([r.epochs for r in rows if r.size]) <= 1 if any(r.size for r in rows) else True
    again = mixing.mixture(wide).collect()
    assert sorted((r.doc_id or -1, r.size, r.epochs) for r in out) == sorted((r.doc_id or -1, r.size, r.epochs) for r in again)
    assert mixing.mixture(empty).count() == 0


def test_the_mix_does_not_depend_on_the_input_s_partitions(spark):
    rng = np.random.default_rng(7)
    rows = [(d, " ".join(f"w{rng.integers(99)}" for _ in range(10)), f"s{k % 3}") for k in range(90) for d in (None, 5)]
    taken = []
    for parts in (1, 3, 5):
        out = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)).collect()
        taken.append(sorted((r.doc_id or -1, r.row, r.epochs) for r in out))
    assert taken[0] == taken[1] == taken[2] and len({e for *_, e in taken[0]}) > 1


# --- shared


def test_shared_folder(spark):
    path = shared.new_path(spark, "x")
    assert path.startswith(shared.shared_dir(spark)) and shared.new_path(spark, "x") != path
    df = shared.written(spark.range(3), "t")
    assert df.count() == 3 and "parquet" in json.dumps(df.inputFiles())
