"""Small document tables with every awkward case, and brute-force counterparts."""

from __future__ import annotations

import random

from pyspark.sql import types as T

# Extra columns whose names the operators use inside.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("n_words", T.StringType()), T.StructField("spans", T.StringType())])


def make_docs(spark, rows):
    return spark.createDataFrame(
        [(i, t, None, None, None, "x", "y", None, "z", None) for i, t in rows], DOCS)


def random_text(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edge_rows():
    rng = random.Random(5)
    long_text = random_text(rng, 30_000)
    return [(1, "plain words in a row, and more of them"), (2, None), (3, ""), (4, "   \n\t "),
            (5, long_text), (6, "plain words in a row, and more of them"), (7, "x"),
            (8, "ÄÖÜ ß İ ſ 漢字 🙂 é́   \x1f"), (None, "a row without an id"),
            (None, None), (9, "same row"), (9, "same row"), (10, "two  spaces\r\nand a break")]


def by_id(rows, name="doc_id"):
    found = {}
    for row in rows:
        found.setdefault(row[name], []).append(row)
    return found
