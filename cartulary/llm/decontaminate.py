"""Benchmark decontamination by template canonicalisation, native (DataFrame functions only).

A text becomes tokens (numbers, or words that start with a letter); a template token is the lower-cased token, or a placeholder:
numbers (any decimal digits), names (a capital after a lower-case letter or comma and a blank, or a word with one capital in front
that isn't one of STARTERS) and units (a word of UNITS after a number). Windows of WINDOW template tokens with at least
MIN_LITERALS words are hashed and joined with those of the benchmark, which are looked for as they are and with names as words, for
texts in small or capital letters.

Items with the same template and the same equalities among their slots are one class, which is looked for once; its items come in
when a class is found. Hits of one document, class and alignment count together: a class is found if its windows there cover
min_tokens tokens (or the whole item, if that is shorter) and its slots are consistent, that is, no placeholder value of an item
stands for two values in the document. So literal copies are found, and questions asked again with other numbers or names.

The tokens that an item must have covered are counted over its windows with enough words, the others can't be found. The first
word of an item is looked for as a word, and as the name or unit that it becomes inside a text; then it must be the same word.
Items without any such window (fewer than WINDOW tokens, or few words) are looked for as a whole: places are found by the hash of up
to PREFIX template tokens behind the first, and there the hash of all tokens behind the first is joined at the lengths that such
items have. With WHOLE_LITERALS words or more they are found with other slot values too, as above (the first token must be the same
word, or fill the same slot), with fewer words only word for word. Items of fewer than EXACT_MIN tokens stand in many texts by
chance; they are found word for word and reported apart, and don't make a document contaminated.

UNITS and STARTERS are English, and a capital inside a sentence makes a name in any language: German nouns are placeholders, so a
German item is found with other nouns in their places too, and needs more words for a window (see the README for figures).

Items are told apart by id and text, so items without an id, or with the same, are looked for too. The benchmark's windows are
counted: up to shared.BROADCAST_BYTES they are broadcast, beyond that the join shuffles. Null and empty texts are clean; rows that
share a doc_id are judged each by its text; a null doc_id keeps its row; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.host_rules import let, tail
from cartulary.llm.shared import NO_ID, doc_key, row_key, scratch, small_or_not, table, written

WINDOW = 8
MIN_LITERALS = 5
#: Items without windows: tokens that make a document contaminated, words that let slots have other values, tokens hashed first.
EXACT_MIN, WHOLE_LITERALS, PREFIX = 3, 4, 4
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "t", "s", "ms", "min", "h", "l", "ml", "j", "w", "kw", "v", "hz", "pa", "percent", "dollars", "euros", "cents", "miles", "feet", "inches", "pounds", "ounces", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "degrees", "meters", "metres", "kilometers", "liters", "litres", "grams", "kilograms")
#: Words that often start a sentence and aren't names.
STARTERS = (
    "a", "about", "after", "all", "although", "an", "and", "another", "any", "are", "as", "at", "because", "before", "both", "but", "by", "calculate", "can", "choose", "compute", "consider", "could", "describe",
    "determine", "did", "do", "does", "during", "each", "either", "estimate", "evaluate", "every", "explain", "find", "first", "for", "from", "given", "has", "have", "he", "her", "here", "his", "how", "however", "i",
    "if", "in", "is", "it", "its", "let", "list", "many", "more", "most", "my", "name", "no", "not", "now", "of", "on", "once", "one", "or", "our", "over", "select", "she", "should", "show", "simplify", "since", "so",
    "solve", "some", "state", "suppose", "that", "the", "their", "then", "there", "these", "they", "this", "those", "through", "to", "two", "under", "use", "using", "was", "we", "were", "what", "when", "where",
    "whether", "which", "while", "who", "whom", "whose", "why", "will", "with", "without", "would", "write", "you", "your",
)
NAME = "\u0002"
_NAMES = r"(?<=[\p{Ll},;:] )(?=\p{Lu})|(?<![\p{L}\p{M}\p{Nd}])(?=\p{Lu}\p{Ll})(?!(?:" + "|".join(x.capitalize() for x in STARTERS) + r")(?![\p{L}\p{M}\p{Nd}]))"
_TOKEN = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*|\u0002?\p{L}[\p{L}\p{M}\p{Nd}]*"
#: The first decimal digit beyond ASCII; tokens below need no pattern to tell them from words.
_FAR_DIGIT = "\u0660"


def tokens(text: Column) -> Column:
    """Array of tokens; names are marked."""
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(NAME), F.lit(" ")), _NAMES, NAME)
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def _is_number(t: Column) -> Column:
    return ((t >= "0") & (t < ":")) | ((t >= _FAR_DIGIT) & t.rlike(r"^\p{Nd}"))


def template(toks: Column) -> Column:
    """Array of template tokens: `#` a number, NAME a name, `%` a unit, else a word."""
    kind = F.transform(toks, lambda t: F.when(_is_number(t), F.lit("#")).when(t.startswith(NAME), F.lit(NAME)).otherwise(F.lower(t)))
    return let(kind, lambda k: F.zip_with(k, F.slice(F.concat(F.array(F.lit("")), k), 1, F.size(k)), lambda t, before: F.when((before == "#") & t.isin(*UNITS), F.lit("%")).otherwise(t)))


def token_hashes(toks: Column) -> Column:
    """Array of the template tokens' hashes. Without a number there is no unit, so most texts need no look at the token before."""
    hashed = lambda t: F.when(t.startswith(NAME), F.xxhash64(F.lit(NAME))).otherwise(F.xxhash64(F.lower(t)))
    return let(toks, lambda k: F.when(F.exists(k, _is_number), F.transform(template(k), lambda t: F.xxhash64(t))).otherwise(F.transform(k, hashed)))


def run_hashes(hashes: Column, length: int) -> Column:
    """Array of the hashes of all runs of length elements: pairs are hashed, then pairs of pairs, and at last two that overlap."""
    def paired(a: Column, n: int) -> Column:
        return let(a, lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0))), tail(x, n), lambda p, q: F.xxhash64(p, q)))

    out, n = hashes, 1
    while 2 * n <= length:
        out = paired(out, n)
        n *= 2
    return out if n == length else paired(out, length - n)


def window_hashes(toks: Column) -> Column:
    """Array of the windows' hashes."""
    return run_hashes(token_hashes(toks), WINDOW)


def plain(t: Column) -> Column:
    return F.lower(F.replace(t, F.lit(NAME), F.lit("")))


def words(toks: Column) -> Column:
    return F.transform(toks, plain)


def covered_by(at: Column) -> Column:
    """Tokens under the windows at these sorted positions."""
    return F.aggregate(F.zip_with(at, tail(at, 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)


def literals(temp: Column) -> Column:
    """Number of the template's words."""
    return F.size(F.filter(temp, lambda x: ~x.isin("#", "%", NAME)))


def _class_of(item: Column, good: Column) -> Column:
    """Hash of an item's template, with each slot's first place of its value; of its words, if it is only found word for word."""
    slots = lambda t, w: F.transform(t, lambda x, i: F.when(x.isin("#", "%", NAME), F.concat(x, F.array_position(w, w[i]).cast("string"))).otherwise(x))
    free = (F.size(good) > 0) | (literals(template(item)) >= WHOLE_LITERALS)
    return F.when(free, let(template(item), lambda t: let(words(item), lambda w: F.xxhash64(slots(t, w))))).otherwise(F.xxhash64(words(item), F.lit("whole")))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """key (item_id with NO_ID for null, hash of the text), item (its tokens), n_tokens, good (positions of the windows with enough words), klass; written."""
    items = benchmark.select(F.struct(doc_key("item_id").alias("item_id"), row_key().alias("hash")).alias("key"), tokens(F.col("text")).alias("item"))
    starts = F.when(F.size("item") >= WINDOW, F.sequence(F.lit(0), F.size("item") - WINDOW)).otherwise(F.array().cast("array<int>"))
    good = let(template(F.col("item")), lambda t: F.filter(starts, lambda p: literals(F.slice(t, p + 1, WINDOW)) >= MIN_LITERALS))
    items = items.select("key", "item", F.size("item").alias("n_tokens"), good.alias("good"))
    return written(items.withColumn("klass", _class_of(F.col("item"), F.col("good"))), "benchmark-items")


def class_samples(items: DataFrame) -> DataFrame:
    """klass, item, n_tokens, good of one item of each class; written."""
    one = F.min(F.struct("key", "item", "n_tokens", "good")).alias("one")
    return written(items.groupBy("klass").agg(one).select("klass", "one.item", "one.n_tokens", "one.good"), "benchmark-classes")


def benchmark_windows(samples: DataFrame) -> DataFrame:
    """klass, ipos, h, coverable, other (the first word in a form that it may have inside a text); written.

    coverable: the tokens under all windows of the item that have enough words."""
    entry = lambda p, h, other: F.struct(p.alias("ipos"), h.alias("h"), F.lit(other).alias("other"))
    of = lambda toks: let(window_hashes(toks), lambda h: F.transform("good", lambda p: entry(p, h[p], False)))
    own = F.array_distinct(F.concat(of(F.col("item")), of(words(F.col("item")))))
    head, rest = F.get("item", F.lit(0)), F.slice("item", 2, WINDOW - 1)
    first = [F.concat(F.array(x), r) for r in (rest, words(rest)) for x in (F.concat(F.lit(NAME), plain(head)), plain(head))]
    hashes = [F.when(~_is_number(head), F.get(window_hashes(t), F.lit(0))) for t in first]
    hashes += [F.get(window_hashes(F.concat(F.array(F.lit("0")), F.slice(t, 1, WINDOW))), F.lit(1)) for t in (F.col("item"), words(F.col("item")))]
    others = lambda o: F.filter(F.transform(F.array_distinct(F.array(*hashes)), lambda h: entry(F.lit(0), h, True)), lambda e: e["h"].isNotNull() & ~F.exists(o, lambda x: (x["ipos"] == 0) & (x["h"] == e["h"])))
    none = F.array().cast("array<struct<ipos:int,h:bigint,other:boolean>>")
    entries = let(own, lambda o: F.concat(o, F.when(F.get("good", F.lit(0)) == 0, others(o)).otherwise(none)))
    rows = samples.filter(F.size("good") > 0).select("klass", covered_by(F.col("good")).alias("coverable"), F.inline(entries))
    return written(rows, "benchmark-windows")


def whole_entries(items: DataFrame) -> DataFrame:
    """klass, n (tokens), free (slots may have other values), item (words), head (hash of the first template token), k, prefix, full: the hashes by
    which items without windows are found, as they are and with names as words; a row for each class and hash. An item of one token has k = 0; written."""
    short = items.filter((F.size("good") == 0) & (F.col("n_tokens") > 0)).select("klass", F.col("n_tokens").alias("n"), "item", words(F.col("item")).alias("words"))
    short = short.withColumn("free", literals(template(F.col("item"))) >= WHOLE_LITERALS).withColumn("k", F.least(F.col("n") - 1, F.lit(PREFIX)))
    form = lambda toks: let(token_hashes(toks), lambda h: F.struct(h[0].alias("head"), _hash_of(h, F.lit(1), F.col("k")).alias("prefix"), _hash_of(h, F.lit(1), F.col("n") - 1).alias("full")))
    one = F.struct(F.xxhash64("words").alias("head"), F.xxhash64(F.col("words")[0]).alias("prefix"), F.xxhash64(F.col("words")[0]).alias("full"))
    forms = F.when(F.col("n") == 1, F.array(one)).otherwise(F.array(form(F.col("item")), form(F.col("words"))))
    rows = short.select("klass", "n", "free", "words", "k", F.inline(forms))
    return written(rows.groupBy("klass", "n", "free", "k", "prefix", "full").agg(F.min(F.struct("words", "head")).alias("one")).select("klass", "n", "free", "k", "prefix", "full", "one.*"), "benchmark-whole")


def _hash_of(hashes: Column, at: Column, n: Column) -> Column:
    """Hash of n elements from the place at on."""
    return F.xxhash64(F.slice(hashes, at + 1, n))


def whole_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc, row, klass, covered, spots, seen: items without windows that stand in a document."""
    entries = whole_entries(items)
    lengths: dict[int, list[int]] = {}
    for r in entries.select("k", "n").distinct().collect():  # as many as such items have lengths
        lengths.setdefault(r.k, []).append(r.n)
    out = lambda df: df.select("doc", "row", "klass", F.col("n").alias("covered"), F.sequence(F.lit(0), F.col("n") - 1).alias("spots"), "seen")
    if not lengths:
        return out(docs.select("doc", "row").join(entries.filter("false").withColumn("seen", F.col("words")), F.lit(False)))

    def prefixes(toks: Column) -> Column:
        """(k, pos, prefix) of each place of a text, for each k that there is; pos: of the item's first token."""
        place = lambda k: lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("prefix"))
        behind = lambda h, k: F.transform(F.sequence(F.lit(1), F.size(h) - k), lambda i: _hash_of(h, i, F.lit(k)))
        of = lambda k: let(token_hashes(toks), lambda h: F.when(F.size(h) > k, F.transform(behind(h, k), place(k))))
        some = [of(k) for k in lengths if k]
        if 0 in lengths:
            some.append(F.transform(toks, lambda t, i: place(0)(F.xxhash64(plain(t)), i)))
        return F.flatten(F.array_compact(F.array(*some)))

    known = small_or_not(written(entries.select("k", "prefix").distinct(), "benchmark-prefixes"), 32)
    places = docs.select("doc", "row", F.inline(prefixes(tokens(F.col("text"))))).join(known, ["k", "prefix"], "left_semi")
    places = written(places.groupBy("doc", "row").agg(F.collect_set(F.struct("k", "pos")).alias("at")), "whole-places").hint("merge")
    text = F.struct(words(F.col("toks")).alias("words"), token_hashes(F.col("toks")).alias("h"))
    texts = docs.join(places, ["doc", "row"]).dropDuplicates(["doc", "row"]).withColumn("toks", tokens(F.col("text"))).select("doc", "row", "at", text.alias("t"))
    of_k = F.create_map(*(x for k, n in lengths.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(n))))))
    tried = texts.select("doc", "row", "t", F.explode("at").alias("p")).select("doc", "row", "t", "p.*", F.explode(of_k[F.col("p.k")]).alias("n")).filter(F.col("pos") + F.col("n") <= F.size("t.h"))
    full = F.when(F.col("k") == 0, F.xxhash64(F.col("t.words")[F.col("pos")])).otherwise(_hash_of(F.col("t.h"), F.col("pos") + 1, F.col("n") - 1))
    tried = tried.select("doc", "row", "n", full.alias("full"), F.col("t.h")[F.col("pos")].alias("own"), F.slice("t.words", F.col("pos") + 1, F.col("n")).alias("seen"))
    both = tried.join(small_or_not(entries.select("klass", "n", "free", "full", "words", "head"), 256), ["n", "full"])
    pairs = F.array_distinct(F.arrays_zip(F.col("words").alias("item"), F.col("seen").alias("doc")))
    consistent = F.size(pairs) == F.size(F.array_distinct("words"))
    head = (F.col("own") == F.col("head")) | (F.get("seen", F.lit(0)) == F.get("words", F.lit(0)))
    return out(both.filter((F.col("seen") == F.col("words")) | (F.col("free") & head & consistent)))


def found_classes(docs: DataFrame, items: DataFrame, min_tokens: int) -> DataFrame:
    """doc, row, klass, covered, spots (places in the item), seen (the document's words there): the classes of items found in each document."""
    samples = class_samples(items)
    known = small_or_not(benchmark_windows(samples), 64)
    windows = docs.select("doc", "row", F.posexplode(window_hashes(tokens(F.col("text")))).alias("dpos", "h"))
    hits = windows.join(known, "h").select("doc", "row", "klass", F.least(F.lit(min_tokens), F.col("coverable")).alias("needed"), "ipos", "other", (F.col("dpos") - F.col("ipos")).alias("shift"))
    places = hits.groupBy("doc", "row", "klass", "shift").agg(F.array_sort(F.collect_set("ipos")).alias("at"), F.first("needed").alias("needed"), F.max("other").alias("other"))
    places = written(places.filter(covered_by(F.col("at")) >= F.col("needed")), "places")

    texts = docs.join(places.select("doc", "row").distinct().hint("merge"), ["doc", "row"], "left_semi").select("doc", "row", words(tokens(F.col("text"))).alias("tokens"))
    both = places.join(texts, ["doc", "row"]).join(samples.select("klass", words(F.col("item")).alias("item")), "klass")
    # The first word's other form stands for any name or unit: its window counts if the word is the same.
    changed = F.col("other") & ~F.get("item", F.lit(0)).eqNullSafe(F.get("tokens", F.col("shift")))
    both = both.withColumn("at", F.when(changed, F.filter("at", lambda p: p > 0)).otherwise(F.col("at"))).withColumn("covered", covered_by(F.col("at"))).filter("covered >= needed")
    # Tokens under the covered windows, side by side; words are equal there, so values that differ fill slots.
    spots = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (WINDOW - 1)))))
    both = both.withColumn("spots", spots).withColumn("pairs", F.array_distinct(F.transform("spots", lambda p: F.struct(F.col("item")[p].alias("item"), F.col("tokens")[p + F.col("shift")].alias("doc")))))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda v: v["item"])))
    seen = F.transform("spots", lambda p: F.col("tokens")[p + F.col("shift")])
    return both.filter(consistent).select("doc", "row", "klass", "covered", "spots", seen.alias("seen")).unionByName(whole_items(docs, items))


def found_items(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13) -> DataFrame:
    """doc, row, item_id (null if it has none), covered, exact: the items found in each document (doc and row identify it); docs has doc, row, text."""
    items = benchmark_items(benchmark)
    found = found_classes(docs, items, min_tokens).join(items.select("klass", "key", words(F.col("item")).alias("item")), "klass")
    exact = F.transform("spots", lambda p: F.col("item")[p]) == F.col("seen")
    found = found.groupBy("doc", "row", "key").agg(F.max("covered").alias("covered"), F.max(exact).alias("exact"))
    return found.select("doc", "row", F.when(F.col("key.item_id") != NO_ID, F.col("key.item_id")).alias("item_id"), "covered", "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13) -> DataFrame:
    """A row per document: doc_id, contaminated, items (sorted ids of the items found; one without an id only makes contaminated true), exact (one of
    them was found word for word), short_items (sorted ids of items of fewer than EXACT_MIN tokens, which count for nothing else)."""
    docs = docs.select("doc_id", doc_key().alias("doc"), row_key().alias("row"), "text")
    with scratch():
        counts = F.col("covered") >= EXACT_MIN
        ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("item_id"))))
        found = found_items(docs, benchmark, min_tokens).groupBy("doc", "row").agg(F.max(counts).alias("contaminated"), ids(counts).alias("items"), F.max(counts & F.col("exact")).alias("exact"), ids(~counts).alias("short_items"))
        found = written(found, "found", keep=True)
    rows = docs.select("doc_id", "doc", "row").join(found.hint("merge"), ["doc", "row"], "left")
    none, no = F.array().cast("array<long>"), F.lit(False)
    return rows.select("doc_id", F.coalesce("contaminated", no).alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("exact", no).alias("exact"), F.coalesce("short_items", none).alias("short_items"))


def clean(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13) -> DataFrame:
    """The documents in which no item is found, with their columns."""
    key = F.struct(doc_key().alias("doc"), row_key().alias("row"))
    with scratch():
        found = found_classes(docs.select(doc_key().alias("doc"), row_key().alias("row"), "text"), benchmark_items(benchmark), min_tokens)
        found = written(found.filter(F.col("covered") >= EXACT_MIN).select(F.struct("doc", "row").alias("__key")).distinct(), "found", keep=True)
    return docs.withColumn("__key", key).join(found.hint("merge"), "__key", "left_anti").drop("__key")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark: doc_id, contaminated, items, exact (see decontaminate)."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
