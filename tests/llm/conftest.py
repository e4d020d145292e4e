import random

import pytest

#: Column names that operators use themselves.
CLASHES = "fp fingerprint component_id digest n_bytes n_tokens bucket packed size h shard slot start length spans path id key label _row_key".split()


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with nulls anywhere, empty and long texts, repeated ids, copies, and columns named like the operators' own."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long = text(120), text(6000)
    rows = [
        (1, base, "en", "s"), (1, base, "en", "s"), (2, base, None, None), (3, text(40) + " " + base + " " + text(30), "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"),
        (6, " \t\n ", "en", "s"), (7, long, "en", "t"), (8, long + " tail", "en", "t"), (None, base + " x", "en", "s"), (None, None, None, None), (9, "one", "en", "s"),
        (9, "two words", "de", "s"), (10, "x" * 500, "en", "s"), (11, "mail a.b@c.de or 4111 1111 1111 1111, +49 30 1234567 and 10.0.0.1", "en", "s"), (12, "\x00 ▁ <|endoftext|> </s> 😀  double", "en", "s"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    from pyspark.sql import functions as F

    return frame.select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def rows(messy):
    """messy as (doc_id, text) tuples."""
    return [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, fp string")
