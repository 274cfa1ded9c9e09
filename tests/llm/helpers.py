"""Small tables with the awkward cases."""

import random

DOCS = "doc_id long, text string, n_words string, kept string, score string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def documents(spark, texts: dict | list):
    """texts: (doc_id, text) pairs; more columns have names that results use."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in pairs], DOCS)


def awkward() -> list[tuple]:
    """Null and repeated ids, null, blank, very long and equal texts."""
    rng = random.Random(1)
    long = " ".join(words(rng, 30_000))
    base = " ".join(words(rng, 60))
    return [
        (1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "ONE  two"),
        (9, long), (10, long + " tail"), (None, base), (11, "x" * 50_000), (12, base), (12, base),
    ]
