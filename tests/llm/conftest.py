import os
import random
import sys

import pytest

sys.path.append(os.path.dirname(os.path.abspath(__file__)))  # one test uses the brute force of another

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stock=None):
    stock = stock or ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [rng.choice(stock) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, repeated rows, ties, odd characters."""
    rng = random.Random(3)
    long = " ".join(words(rng, 30_000))
    texts = [None, "", " \n\t ", "a", "one two", "Hello, World! It's 3 o'clock.", long, long, "ÄÖÜ ß naïve 漢字 かな 😀 ́x", "a\x1cb\x1fc d e", "x" * 50_000, "a b c d e f", "A B  C\nD\tE F", "\x00 nul", "<|endoftext|> <|im_end|>"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[5], (None, "no id here at all", None, None, None)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows, with columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, DOCS)
    for c in ("n_words", "kept", "score", "label", "tokens", "token", "component_id", "s", "n", "g", "id", "ids", "part", "words", "start", "length", "sequence_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(2)  # or the optimiser would work the rows out on its own, interpreted


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
