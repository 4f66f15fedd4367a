"""Functions of texts and queries. Names ending in _py work on one Python string (a query), others on columns."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.constants import GENERAL_INTENT, INTENTS, STOP_WORDS, SYNONYMS

_ASCII = re.ASCII


def normalize_query_py(query: str) -> str:
    """Lower case; what isn't a word character or white space becomes a blank; blanks collapse."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", query.lower(), flags=_ASCII)).strip()


def normalize_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\w\s]", " "), r"\s+", " "))


def expand_query_py(query: str) -> str:
    """The query with the synonyms of its words that it doesn't contain (also not inside a word)."""
    extra = [s for word in query.lower().split() for s in SYNONYMS.get(word, ()) if s not in query]
    return " ".join([query, *extra]) if extra else query


def keywords_py(query: str) -> list[str]:
    return [k for k in query.lower().split() if len(k) > 1 and k not in STOP_WORDS]


def keywords(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda k: (F.length(k) > 1) & ~k.isin(*STOP_WORDS))


def intent(query: Column) -> Column:
    low = F.lower(F.coalesce(query, F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    out = F.lit(GENERAL_INTENT)
    for groups, name in reversed(INTENTS):
        out = F.when(reduce(lambda a, b: a & b, map(any_of, groups)), name).otherwise(out)
    return out


def intent_py(query: str) -> str:
    low = query.lower()
    return next((name for groups, name in INTENTS if all(any(w in low for w in g) for g in groups)), GENERAL_INTENT)


def match_score(query: str, name: Column, full_name: Column, doc: Column, signature: Column, exported: Column) -> Column:
    """How well a function fits the query's keywords, 0 to 1."""
    words = keywords_py(query)
    if not words:
        return F.lit(0.1)
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (name, full_name, doc, signature)]
    points = F.lit(0.0)
    for w in words:
        points = points + F.when(low[0].contains(w), 3.0).when(low[1].contains(w), 2.0).otherwise(0.0) + F.when(low[2].contains(w), 1.0).otherwise(0.0) + F.when(low[3].contains(w), 0.5).otherwise(0.0)
    return F.least(points / F.lit(float(3 * len(words))) + F.when(exported, 0.1).otherwise(0.0), F.lit(1.0))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def token_estimate_py(text: str) -> int:
    return math.ceil(len(text) / 4)


def short_id(key: Column) -> Column:
    """First 12 hex digits of the key's MD5."""
    return F.substring(F.md5(key), 1, 12)


def round2(x: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)


def percent(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)).cast("int")


def last_part(text: Column, separator: str = ":") -> Column:
    return F.substring_index(text, separator, -1)


def module_name(path: Column) -> Column:
    """Last path segment with - and _ as blanks and the first letter of each word in upper case."""
    spaced = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[-_]", " ")
    runs = F.regexp_extract_all(spaced, F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def is_camel(name: Column) -> Column:
    return name.rlike(r"^[a-z][a-zA-Z0-9]*\z")


def is_pascal(name: Column) -> Column:
    return name.rlike(r"^[A-Z][a-zA-Z0-9]*\z")


def is_snake(name: Column) -> Column:
    return name.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*\z")


def dot_product(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, summed in double from first to last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def function_text(name: Column, signature: Column, doc: Column) -> Column:
    """What is embedded of a function: at most 512 characters."""
    parts = F.filter(F.array(name, signature, doc), lambda x: x.isNotNull() & (x != ""))
    return F.substring(F.trim(F.array_join(parts, " ")), 1, 512)


def class_text(name: Column, methods: Column) -> Column:
    """What is embedded of a class: its name and up to ten methods."""
    names = F.transform(F.slice(F.coalesce(methods, F.array().cast("array<string>")), 1, 10), lambda m: last_part(m))
    return F.substring(F.trim(F.concat(F.lit("class "), name, F.lit(" "), F.array_join(names, " "))), 1, 512)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def badge(confidence: Column, high: float = 0.9, medium: float = 0.7) -> Column:
    return F.when(confidence > high, "HIGH").when(confidence > medium, "MED").otherwise("LOW")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def like_any(columns: list[Column], words: list[str]) -> Column:
    """Some column matches %word% for some word; _ and % in a word are wildcards; case is ignored."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit("")).ilike("%" + w.replace("\\", "\\\\") + "%") for w in words for c in columns))
