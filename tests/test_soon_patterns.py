"""The patterns that find words sooner find what the plain ones find."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kuchikomi.functions import tokens
from kuchikomi.operators import features
from kuchikomi.domain import ASPECTS

LETTERS = "ab9 Z\n\t\x00\x1f\x7f\x85 -_~`{}[]@^\\ß́é部二〇ひガー가Яλ１Ⅷ²🙂゙x'!"


def test_same_words_and_segments(spark):
    rng = random.Random(3)
    texts = spark.createDataFrame([("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 25))),) for _ in range(3000)], "t string")
    found = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    both = texts.select((found(tokens.WORD) == found(tokens.SOON_WORD)).alias("w"), (found(tokens.SEGMENT) == found(tokens.SOON_SEGMENT)).alias("s"))
    assert both.where("not w or not s or w is null or s is null").isEmpty()


def test_brackets_are_encoded_once_for_each_aspect(spark):
    vocabulary = spark.createDataFrame([(4, "a", 1)], "id int, piece string, n bigint")
    research = spark.createDataFrame([("r1", "some text", {a: 4.0 for a in ASPECTS[:3]}), ("r2", "other text", {"room": 1.0})], "review_id string, comment string, scores map<string,double>")
    rows = features.corpus_features(research, vocabulary, 16)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "_bracket AS" not in plan.split("Join")[0]
    assert {(r.review_id, r.aspect_idx) for r in rows.collect()} == {("r1", 0), ("r1", 1), ("r1", 2), ("r2", 0)}
