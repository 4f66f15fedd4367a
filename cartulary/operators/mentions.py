"""Which of many words each text mentions, as keyword search would find them: %word%, where _ is any character and % any characters.

The words of a shard make one Aho-Corasick automaton, over their longest pieces without wildcards, and a text streams past it once;
a piece that is found is checked with the rest of its word. All words in one shard are sent to the tasks that read the texts, which
are not shuffled; more words (their characters are counted) are cut into shards, and slices of the texts meet each shard.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the words of a shard, about; its automaton takes some 100 bytes for each.
SHARD_CHARS = 1 << 20
#: Characters of the texts that meet a shard in one task, about.
SLICE_CHARS = 1 << 24

FIELDS = ("name", "full_name", "doc_comment")


class Finder:
    """An automaton over words."""

    def __init__(self, words: list[str]):
        self.short: dict[int, dict[str, int]] = {1: {}, 2: {}}  # plain words of one and two characters
        self.checks: list[list[tuple[int, int, str | re.Pattern | None]]] = []  # of each piece: word, place in it, what else to check
        bare, pieces = [], {}
        for i, word in enumerate(words):
            piece = max(re.split("[_%]", word), key=len)
            if not piece:
                bare.append((word.count("_"), i))  # any text of so many characters
            elif piece == word and len(word) in self.short:
                self.short[len(word)][word] = i
            else:
                more = None if piece == word else word if "%" not in word else re.compile("".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in word), re.DOTALL)
                if piece not in pieces:
                    pieces[piece] = len(self.checks)
                    self.checks.append([])
                self.checks[pieces[piece]].append((i, word.find(piece), more))
        self.bare = sorted(bare)
        self.automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():
            self.automaton.add_word(piece, (i, len(piece)))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def found(self, texts: list[str]) -> set[int]:
        """The words that some of the texts match."""
        out = {i for _, i in self.bare[: bisect_right(self.bare, max(map(len, texts)), key=lambda x: x[0])]}
        for text in texts:
            for n, words in self.short.items():
                if words:
                    out.update(words[g] for g in {text[i : i + n] for i in range(len(text) - n + 1)} & words.keys())
            if not self.any:
                continue
            done = set()
            for end, (piece, size) in self.automaton.iter(text):
                if piece in done:
                    continue
                plain = True
                for i, offset, more in self.checks[piece]:
                    if i in out:
                        continue
                    if more is None:
                        out.add(i)
                    elif isinstance(more, str):
                        lo = end - size + 1 - offset
                        if lo >= 0 and lo + len(more) <= len(text) and all(c == "_" or c == text[lo + j] for j, c in enumerate(more)):
                            out.add(i)
                        else:
                            plain = False
                    elif more.search(text):
                        out.add(i)
                if plain:  # nothing of this piece can be found further on
                    done.add(piece)
        return out


def _matches(finder: Finder, words: list[str], t: pa.RecordBatch | pa.Table) -> dict[str, list]:
    """word and file_id of each mention."""
    said, files = [], []
    for key, *texts in zip(t.column("file_id").to_pylist(), *(t.column(c).to_pylist() for c in FIELDS), strict=True):
        found = finder.found(list(dict.fromkeys(texts)))
        said += [words[i] for i in found]
        files += [key] * len(found)
    return {"word": said, "file_id": files}


_SCHEMA = pa.schema([("word", pa.string()), ("file_id", pa.string())])
_DDL = "word string, file_id string"


def mentions(words: DataFrame, functions: DataFrame) -> DataFrame:
    """(word, file_id), distinct: files of which a function's name, full name or comment matches %word%. words: (word) in lower case; nulls match nothing."""
    words = words.filter("word is not null").distinct()
    texts = functions.select("id", "file_id", *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in FIELDS))
    shards = -(-(words.agg(F.sum(F.length("word") + 1)).first()[0] or 0) // SHARD_CHARS)
    if shards <= 1:
        few = [r.word for r in words.collect()]  # SHARD_CHARS characters at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(few)
            for b in batches:
                yield pa.record_batch(_matches(finder, few, b), schema=_SCHEMA)

        return texts.mapInArrow(run, _DDL).distinct()
    size = texts.agg(F.sum(sum(F.length(c) for c in FIELDS))).first()[0] or 0
    slices = max(1, -(-size // SLICE_CHARS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = words.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")).withColumn("slice", each(slices))
    right = texts.withColumn("slice", F.pmod(F.xxhash64("id", *FIELDS[:2]), F.lit(slices)).cast("int")).withColumn("shard", each(shards))

    def pair(names: pa.Table, said: pa.Table) -> pa.Table:
        own = names.column("word").to_pylist()
        return pa.table(_matches(Finder(own), own, said), schema=_SCHEMA)

    return left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(pair, _DDL).distinct()
