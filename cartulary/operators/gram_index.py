"""Keyword search by posting lists of character grams.

Each bucket of a table has an index beside it, written by the same change: for each run of two or three characters of the indexed
fields (in lower case) the ids of the bucket's rows that hold it, in parts by a hash of the gram. Rows are dealt to slices of a
bucket before their grams are taken, so rows are shuffled and never their many grams; each slice has lists of its own. A word's
rows hold all grams of its pieces without wildcards. A lookup counts the grams, intersects the lists of each word's rarest ones,
and reads only the buckets that have candidates; the search itself then tests what is left, so it finds the same rows as a scan.
Words without such a piece, and words whose rarest gram most rows hold, need the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Table -> its index and the fields that are indexed.
SOURCES = {"functions": ("function_grams", ("name", "full_name", "doc_comment")), "files": ("file_grams", ("path",))}
#: Parts of a bucket's index.
PARTS = 4
#: Rows of a bucket's slice, about.
SLICE_ROWS = 1 << 15
#: Lists that are intersected for a word, at most.
RAREST = 3
#: Share of all rows that the rarest gram may have; beyond that a scan is cheaper.
SCAN_SHARE = 0.2


def part_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def postings(rows: DataFrame, fields: tuple[str, ...], buckets: int) -> DataFrame:
    """rows (bucket, id, fields) of a written table, in so many buckets -> bucket, part, gram, n, ids: a list for each gram of a slice of a bucket. A slice is in one task."""
    runs = lambda c, n: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    grams = F.explode(F.array_distinct(F.concat(*(runs(c, n) for c in fields for n in (2, 3)))))
    n, buckets = rows.count(), max(1, buckets)  # counts come from the files' footers
    slices = -(-n // (buckets * SLICE_ROWS)) or 1
    tasks = min(buckets * slices, 4 * n // SLICE_ROWS + 1)
    dealt = rows.select("bucket", F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"), "id", *fields).repartition(tasks, "bucket", "slice")
    held = dealt.select("bucket", "slice", "id", grams.alias("gram")).groupBy("bucket", "slice", "gram").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return held.select("bucket", part_of(F.col("gram")).alias("part"), "gram", F.size("ids").alias("n"), "ids", F.col("bucket").alias("of_bucket"))


def grams_of(word: str) -> set[str]:
    """Grams that every text with a match of %word% holds: three characters long, or two where no piece has three."""
    pieces = re.split("[_%]", word.lower())
    return next((g for n in (3, 2) if (g := {p[i : i + n] for p in pieces for i in range(len(p) - n + 1)})), set())


def candidates(index: Callable[[list[str]], DataFrame], rows: int, words: list[str]) -> DataFrame | None:
    """(of_bucket, id) of the rows that may match some of the words; None if a scan is needed.

    index: gives the posting lists of some grams (bucket, gram, n, ids, of_bucket). rows: of the table."""
    wanted = [grams_of(w) for w in words]
    if not all(wanted) or not words:
        return None
    every = sorted(set().union(*wanted))
    counts = {r.gram: r.n for r in index(every).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # the query's grams
    sets = []
    for grams in wanted:
        rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
        if counts.get(rarest[0], 0) > SCAN_SHARE * rows:
            return None
        if counts.get(rarest[0], 0):
            sets.append(rarest)
    if not sets:
        return index(every).filter("false").select("of_bucket", F.lit("").alias("id"))
    needed = sorted(set().union(*sets))
    has = index(needed).select("of_bucket", F.explode("ids").alias("id"), "gram").groupBy("of_bucket", "id").agg(F.collect_set("gram").alias("grams"))
    held = [F.size(F.array_intersect("grams", F.array(*map(F.lit, s)))) == len(s) for s in sets]
    some = held[0]
    for h in held[1:]:
        some = some | h
    return has.filter(some).select("of_bucket", "id")
