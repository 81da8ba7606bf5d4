"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, row string, block int"
SYLLABLES = "an on the ing er tion ha st re of ea and ou th is ti".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), 0.5, "x", "y", 7)


def documents(spark, texts, first=0):
    """A table with columns that clash with the operators' own."""
    return spark.createDataFrame([row(first + i, t) for i, t in enumerate(texts)], SCHEMA)


def awkward(spark):
    rng = random.Random(5)
    long_text = sentence(rng, 6000)
    rows = [row(2**60 + 1, "Of the\tthing, Ha!"), row(None, "an id is missing"), row(3, None), row(4, ""), row(5, "   \n"), row(6, "Déjà vu naïve Straße ñandú 数据 😀"), row(7, long_text), row(8, long_text), row(9, "of the thing ha"), row(9, "of the thing ha"), row(10, None, None), row(11, "x" * 5000)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")
