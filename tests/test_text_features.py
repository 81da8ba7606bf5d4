from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kuchikomi.domain import SPECIAL_PIECES
from kuchikomi.operators import features, vocabulary

TEXTS = [
    "部屋がとても綺麗で、部屋からの眺めも良い。",
    "The rooms were clean, the room service was the best!",
    "朝食バイキングがとても美味しい😀 とても良い",
    "",
    "room room rooms bathroom",
    None,
]
RUN = regex.compile(
    r"\p{Han}+|\p{Hiragana}+|[\p{Katakana}ー]+|\p{Hangul}+|\p{Cyrillic}+|\p{Greek}+|[\p{Latin}\p{M}]+|\p{N}+|(?s:.)"
)


def expected_vocabulary(texts, size, max_chars):
    segments = Counter(s for t in texts if t for s in RUN.findall(t))
    chars, grams = Counter(), Counter()
    for s, n in segments.items():
        for c in s:
            chars[c] += n
        for k in range(2, max_chars + 1):
            for i in range(len(s) - k + 1):
                grams[s[i : i + k]] += n
    order = lambda item: (-item[1] * len(item[0]), item[0].encode())
    pieces = [p for p, _ in sorted(chars.items(), key=order)] + [p for p, _ in sorted(grams.items(), key=order)]
    n_chars = len(chars)
    return dict(enumerate([*SPECIAL_PIECES, *pieces[: max(size - 4, n_chars)]]))


def greedy(text, pieces):
    found, i, longest = [], 0, max(map(len, pieces))
    while i < len(text):
        k = next((k for k in range(longest, 1, -1) if text[i : i + k] in pieces and len(text[i : i + k]) == k), 1)
        found.append(text[i : i + k])
        i += k
    return found


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(3)


@pytest.mark.parametrize("size", [10, 80, 400])
def test_vocabulary_against_counting(texts, size):
    found = {r.id: r.piece for r in vocabulary.train_vocabulary(texts, "t", size=size, max_chars=4).collect()}
    assert found == expected_vocabulary(TEXTS, size, 4)


def test_segments_are_shuffled_once(texts):
    trained = vocabulary.train_vocabulary(texts, "t", size=100)
    trained.collect()
    plan = trained._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1


def test_encoding_against_greedy_match(spark, texts):
    table = vocabulary.train_vocabulary(texts, "t", size=150, max_chars=5).cache()
    ids = {r.piece: r.id for r in table.collect() if r.id > 3}
    unseen = [*TEXTS, "未知の漢字 rooms!\n\t[x] zzz", r"\Q.*+?\E", "ro", "が" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(unseen)], "i int, t string")
    for r in vocabulary.encode(df, "t", table).collect():
        if r.t is None:
            assert r.subword_pieces is None and r.subword_ids is None
            continue
        assert r.subword_pieces == greedy(r.t, ids)
        assert "".join(r.subword_pieces) == r.t
        assert r.subword_ids == [ids.get(p, 1) for p in r.subword_pieces]


def test_encoding_with_a_vocabulary_of_characters_only(spark, texts):
    table = vocabulary.train_vocabulary(texts, "t", size=5).where("length(piece) = 1 or id < 4").cache()
    found = vocabulary.encode(spark.createDataFrame([("部屋x☃",)], "t string"), "t", table).first()
    assert found.subword_pieces == ["部", "屋", "x", "☃"] and found.subword_ids[-1] == 1


def test_vocabulary_lookups(texts):
    table = vocabulary.train_vocabulary(texts, "t", size=60)
    assert [r.piece for r in vocabulary.vocabulary_head(table, 4).collect()] == list(SPECIAL_PIECES)
    assert {r.id for r in vocabulary.pieces_by_id(table, (10, 50, 5000)).collect()} == {10, 50}


def test_token_statistics(spark, texts):
    table = vocabulary.train_vocabulary(texts, "t", size=150).cache()
    found = {r.granularity: r for r in features.token_statistics(texts, "t", table).collect()}
    lengths = [len(t) for t in TEXTS if t is not None]
    assert found["character"].mean_tokens == sum(lengths) / len(lengths)
    assert (found["character"].min_tokens, found["character"].max_tokens) == (0, max(lengths))
    assert found["character"].tokens_per_character == 1.0
    assert found["subword"].tokens_per_character < 1.0


def test_token_preview(texts):
    table = vocabulary.train_vocabulary(texts, "t", size=60)
    shown = features.token_preview(texts.where("t <> ''"), "t", table, ["i"], n=2).orderBy("i").collect()
    assert len(shown) == 2
    assert shown[0].characters.startswith("部 | 屋 | が") and shown[0].words.startswith("部屋 | がとても | 綺麗")
    assert shown[0].subwords.replace(" | ", "") == TEXTS[0]


def test_feature_rows(spark, texts):
    table = vocabulary.train_vocabulary(texts, "t", size=150).cache()
    ids = {r.piece: r.id for r in table.collect() if r.id > 3}
    rows = spark.createDataFrame(
        [("r1", "room", TEXTS[0], 2), ("r2", "spa", None, 0), ("r3", "bath", "x" * 100, 1)],
        "review_id string, aspect string, comment string, sentiment_label int",
    )
    found = {r.review_id: r for r in features.feature_rows(rows, table, 16).collect()}
    for r in found.values():
        assert {len(r.char_ids), len(r.word_ids), len(r.subword_ids), len(r.attention_mask)} == {16}
    text = f"[room] {TEXTS[0]}"
    assert found["r1"].char_ids == [ord(c) % 5000 for c in text][:16]
    pieces = greedy(text, ids)
    assert found["r1"].subword_ids == ([ids.get(p, 1) for p in pieces] + [0] * 16)[:16]
    word = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 50000
    assert found["r1"].word_ids[:6] == [word(w) for w in ["[", "room", "]", "部屋", "がとても", "綺麗"]]
    assert (found["r1"].aspect_idx, found["r2"].aspect_idx, found["r3"].label) == (0, -1, 1)
    assert found["r2"].char_ids == [ord(c) for c in "[spa] "] + [0] * 10
    assert sum(found["r2"].attention_mask) == len(greedy("[spa] ", ids))


def test_review_level_features_equal_row_level_ones(spark, texts):
    table = vocabulary.train_vocabulary(texts, "t", size=150).cache()
    research = texts.select(
        F.lit("h").alias("hotel_id"), F.lit("h").alias("hotel_name"), F.col("i").cast("string").alias("review_id"),
        F.col("t").alias("comment"), F.lit("2024-01-01").alias("post_datetime"),
        F.create_map(F.lit("room"), F.lit(4.0), F.lit("dinner"), F.lit(2.0), F.lit("bath"), F.lit(0.0)).alias("scores"),
    )
    from kuchikomi.operators.corpus import aspect_corpus

    for length in (4, 12, 40):
        direct = features.feature_rows(aspect_corpus(research), table, length)
        shared = features.corpus_features(research, table, length)
        assert shared.columns == direct.columns
        assert direct.count() == 8 and direct.exceptAll(shared).count() == 0


def test_words_from_a_pandas_udf(spark, texts):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def by_space(text: pd.Series) -> pd.Series:
        return text.fillna("").str.split()

    table = vocabulary.train_vocabulary(texts, "t", size=60).cache()
    found = features.token_counts(texts, "t", table, words=by_space).collect()
    assert {r.t: r.word for r in found} == {t: len((t or "").split()) for t in TEXTS}
