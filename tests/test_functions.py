from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kuchikomi.functions import predictions, scores, text, time, tokens

# Every character Python treats as whitespace.
PYTHON_SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_clean_text_matches_split_and_join(values):
    samples = ["　部屋\t が\n良い　", "", None, *[f"a{s}{s}b{s}" for s in PYTHON_SPACES]]
    expected = [" ".join((t or "").split()) for t in samples]
    assert values(text.clean_text(F.col("t")), samples) == expected


def test_strip_and_lengths(values):
    samples = ["　abc　", "　　", "", None, "a😀 ", "x\n\n"]
    assert values(text.strip(F.col("t")), samples) == ["abc", "", "", None, "a😀", "x"]
    assert values(text.stripped_length(F.col("t")), samples) == [3, 0, 0, None, 2, 1]
    assert values(text.char_length(F.col("t")), samples) == [5, 2, 0, None, 3, 3]


def test_preview(values):
    assert values(text.preview(F.col("t"), 3), ["abc", "abcd", None, "日本語訳"]) == ["abc", "abc...", None, "日本語..."]


def test_score_map_keeps_last_entry_and_null_scores(spark):
    entries = [("ROOM", 1.0), ("Bath", None), ("", 3.0), (None, 4.0), ("room", 2.5), ("bath", 5.0), ("Dinner", None)]
    rows = spark.createDataFrame([(entries,), ([],), (None,)], "scores array<struct<code:string,score:double>>")
    found = [r.m for r in rows.select(scores.score_map(F.col("scores")).alias("m")).collect()]
    assert found == [{"room": 2.5, "bath": 5.0, "dinner": None}, {}, {}]


def test_sentiment_limits(spark):
    stars = [0.5, 2.0, 2.5, 3.0, 3.5, 5.0, None]
    rows = spark.createDataFrame([(s,) for s in stars], "s double").select(scores.sentiment(F.col("s")).alias("v"))
    assert [r.v for r in rows.collect()] == [0, 0, 2, 1, 2, 2, None]


def test_polarity_recoding(spark):
    rows = spark.createDataFrame([(v,) for v in (-1, 0, 1, 7, None)], "l int")
    assert [r.v for r in rows.select(scores.recode_polarity(F.col("l")).alias("v")).collect()] == [0, 1, 2, None, None]


def test_aspect_ids_and_names(values, spark):
    assert values(scores.aspect_index(F.col("t")), ["room", "dinner", "spa", None]) == [0, 7, -1, -1]
    ids = spark.createDataFrame([(0,), (7,), (-1,), (8,)], "i int")
    assert [r.v for r in ids.select(scores.aspect_label(F.col("i")).alias("v")).collect()] == ["room", "dinner", "-1", "8"]


def test_months_are_cut_in_utc(values):
    stamps = ["2024-02-01T03:04:05+09:00", "2024-02-01", "2024-02-01T00:00:00Z", None, "soon"]
    assert values(time.month_of(time.parse_lenient(F.col("t"))), stamps) == ["2024-01", "2024-02", "2024-02", None, None]
    assert values(time.month_start(F.col("t")), ["2024-02"]) == [dt.date(2024, 2, 1)]


def test_strict_parsing_fails_on_malformed_time(values):
    assert values(time.month_of(time.parse_strict(F.col("t"))), ["2024-02-01", None]) == ["2024-02", None]
    with pytest.raises(PySparkException, match="not a timestamp: soon"):
        values(time.parse_strict(F.col("t")), ["soon"])


def test_char_tokens_and_ids(values):
    samples = ["部屋😀a", "", None]
    assert values(tokens.char_tokens(F.col("t")), samples) == [list("部屋😀a"), [], None]
    assert values(tokens.char_ids(tokens.char_tokens(F.col("t"))), samples) == [[ord(c) % 5000 for c in "部屋😀a"], [], None]


def test_word_tokens_split_scripts(values):
    found = values(tokens.word_tokens(F.col("t")), ["部屋がとてもキレイー。Wi-Fi　3階😀", "", "Übergrößen naïve"])
    assert found == [["部屋", "がとても", "キレイー", "。", "Wi", "-", "Fi", "3", "階", "😀"], [], ["Übergrößen", "naïve"]]


def test_padding_and_mask(spark):
    rows = spark.createDataFrame([([7, 8],), ([1, 2, 3, 4, 5],), ([],)], "ids array<int>")
    found = rows.select(tokens.padded(F.col("ids"), 4).alias("p"), tokens.attention(F.col("ids"), 4).alias("m")).collect()
    assert [r.p for r in found] == [[7, 8, 0, 0], [1, 2, 3, 4], [0, 0, 0, 0]]
    assert [r.m for r in found] == [[1, 1, 0, 0], [1, 1, 1, 1], [0, 0, 0, 0]]


def test_predicted_class_takes_first_on_ties_and_ignores_fourth(spark):
    rows = spark.createDataFrame([([0.1, 0.5, 0.5, 9.0],), ([1.0, 0.0, 0.0, 7.0],), ([-3.0, -2.0, -1.0],)], "l array<double>")
    assert [r.v for r in rows.select(predictions.predicted_class(F.col("l")).alias("v")).collect()] == [1, 0, 2]


def test_clean_text_leaves_single_spaces_alone(values):
    """A single space between words is no match of the pattern, so nothing is replaced there; all other runs are."""
    samples = [" a b ", "a \tb", "a\t b", "a  b", "　a b　 c", "​a ​ b", "é\xa0ñ \xa0~", " ", "  \n"]
    assert values(text.clean_text(F.col("t")), samples) == [" ".join(t.split()) for t in samples]
    assert values(F.regexp_count(F.col("t"), F.lit(text._RUN)), samples) == [0, 1, 1, 1, 2, 0, 2, 0, 1]
