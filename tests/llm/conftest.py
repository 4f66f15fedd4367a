import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = ("doc", "row", "size", "key", "rules", "node", "n", "h1", "pos", "line", "x", "anchor", "at", "spans", "bucket", "set", "host", "all", "rank", "target", "epochs", "found", "items", "page", "first", "digest")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages and lines, odd rows."""
    rng = random.Random(5)
    passage, line = words(rng, 60), "a line that very many documents have in common"
    rows = []
    for i in range(60):
        text = words(rng, rng.choice([3, 20, 80, 200]))
        if i % 5 == 1:
            text = f"{text}\n{passage}\n{words(rng, 10)}"
        if i % 7 == 2:
            text = f"{line}\n{text}\n  {line.upper()}\t"
        rows.append((i, text, "en", f"s{i % 3}" if i % 4 else "s0"))
    for i in range(60, 75):
        base = rows[rng.randrange(60)][1].split(" ")
        for _ in range(i % 4):
            base[rng.randrange(len(base))] = f"edit{rng.random():.3f}"
        rows.append((i, " ".join(base), "en", "s1"))
    rows += [(80, "", "en", "s0"), (81, None, None, None), (82, " \t\n ", "en", "s0"), (83, "one", "en", "s0"), (84, "One", "en", "s0"), (None, words(rng, 90), "en", "s2"), (90, passage, "en", "s1"), (90, passage, "en", "s1"), (91, words(rng, 50), "en", "s2"), (91, words(rng, 50), "en", "s2")]
    rows += [(92, words(rng, 30000), "en", "s2"), (93, "y" * 200_000, "en", "s2"), (94, "x\r\ny\x0bz u v é", "en", "ü"), (95, (words(rng, 40) + "\n") * 30, "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, None) for r in corpus], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """docs with clashing columns."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(7).alias(c) for c in CLASHING))
