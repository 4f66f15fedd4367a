"""Embeddings: a pluggable model over batches of texts, and a deterministic model that needs no download.

The built-in model hashes words and their letter trigrams into a fixed number of signed dimensions and scales to unit length, so
texts that share words and word parts are near. Any function from a list of texts to a list of unit vectors can take its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import class_text, function_text

DIMENSIONS = 384
Model = Callable[[list[str]], list[list[float]]]
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def hashing_model(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    out = []
    for text in texts:
        v = np.zeros(dimensions)
        for word in (w.lower() for w in _WORD.findall(text)):
            grams = [f"^{word}$"[i : i + 3] for i in range(len(word))]
            for part, weight in [(word, 1.0), *((g, 0.5 / len(grams)) for g in grams)]:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += weight if h >> 63 else -weight
        norm = float(np.sqrt(v @ v))
        out.append((v / norm if norm else v).tolist())
    return out


def embed(texts: DataFrame, model: Model = hashing_model) -> DataFrame:
    """texts (entity_id, entity_type, text) -> (entity_id, entity_type, embedding). A batch that the model fails on is tried text by text; texts that it fails on are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                vectors: list = model(b["text"].tolist())
            except Exception:  # noqa: BLE001
                vectors = []
                for t in b["text"]:
                    try:
                        vectors += model([t])
                    except Exception:  # noqa: BLE001
                        vectors.append(None)
            out = b[["entity_id", "entity_type"]].assign(embedding=vectors)
            yield out[out["embedding"].notna()]

    return texts.select("entity_id", "entity_type", "text").mapInPandas(run, "entity_id string, entity_type string, embedding array<float>")


def entity_texts(functions: DataFrame, classes: DataFrame) -> DataFrame:
    f = functions.select(F.col("id").alias("entity_id"), F.lit("function").alias("entity_type"), function_text(F.col("name"), F.col("signature"), F.col("doc_comment")).alias("text"))
    return f.union(classes.select("id", F.lit("class"), class_text(F.col("name"), F.col("methods"))))
