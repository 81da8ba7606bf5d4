"""Token statistics, previews and model features at character, subword and word granularity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS, SEQUENCE_LENGTH
from kuchikomi.functions.scores import aspect_index
from kuchikomi.functions.text import char_length
from kuchikomi.functions.tokens import SOON_WORD, attention, char_ids, char_tokens, leading_words, padded, shown, word_ids, word_tokens
from kuchikomi.operators.corpus import aspect_corpus
from kuchikomi.operators.vocabulary import encode

GRANULARITIES = ("character", "subword", "word")

# How words are found: an expression from text to an array of words. The default splits script runs; a
# morphological tagger can be passed as a pandas UDF.
Words = Callable[[Column], Column]


def token_counts(df: DataFrame, column: str, vocabulary: DataFrame, words: Words = word_tokens) -> DataFrame:
    """Add the number of character, subword and word tokens of each text."""
    return encode(df, column, vocabulary).select(
        *df.columns,
        char_length(F.col(column)).alias("character"),
        F.size("subword_pieces").cast("bigint").alias("subword"),
        (F.regexp_count(column, F.lit(SOON_WORD)) if words is word_tokens else F.size(words(F.col(column)))).cast("bigint").alias("word"),
    )


def token_statistics(df: DataFrame, column: str, vocabulary: DataFrame, words: Words = word_tokens) -> DataFrame:
    """Mean, median, minimum and maximum token count per granularity, and tokens per character.

    The ratio is one of means. Counts are first reduced to a histogram, which the exact median reads.
    """
    counts = token_counts(df.select(column), column, vocabulary, words).where(F.col(column).isNotNull())
    long = counts.select(*GRANULARITIES).unpivot([], list(GRANULARITIES), "granularity", "tokens")
    histogram = long.groupBy("granularity", "tokens").agg(F.count(F.lit(1)).alias("n"))
    summary = histogram.groupBy("granularity").agg(
        F.sum(F.col("tokens") * F.col("n")).alias("total"),
        F.sum("n").alias("texts"),
        F.percentile("tokens", F.lit(0.5), F.col("n")).alias("median_tokens"),
        F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"),
    )
    # A window over one row per granularity.
    characters = F.max(F.when(F.col("granularity") == GRANULARITIES[0], F.col("total"))).over(Window.partitionBy())
    return summary.select(
        "granularity",
        (F.col("total") / F.col("texts")).alias("mean_tokens"),
        "median_tokens",
        "min_tokens",
        "max_tokens",
        F.try_divide("total", characters).alias("tokens_per_character"),
    )


def token_preview(
    df: DataFrame, column: str, vocabulary: DataFrame, order_by: list[str], n: int = 10, words: Words = word_tokens
) -> DataFrame:
    """The first texts with their characters, subwords and words side by side."""
    sample = df.orderBy(*order_by).limit(n)
    return encode(sample, column, vocabulary).select(
        *df.columns,
        shown(char_tokens(F.col(column))).alias("characters"),
        shown(F.col("subword_pieces")).alias("subwords"),
        shown(words(F.col(column))).alias("words"),
    )


def conditioned_text(aspect: Column, comment: Column) -> Column:
    """``[aspect] comment``; a null comment is empty."""
    return F.concat(F.lit("["), aspect, F.lit("] "), F.coalesce(comment, F.lit("")))


def feature_columns(chars: Column, words: Column, subwords: Column, length: int) -> list[Column]:
    """The fixed-length sequences of one example from its unpadded ids."""
    return [
        padded(chars, length).alias("char_ids"),
        padded(words, length).alias("word_ids"),
        padded(subwords, length).alias("subword_ids"),
        attention(subwords, length).alias("attention_mask"),
    ]


def feature_rows(
    aspects: DataFrame, vocabulary: DataFrame, length: int = SEQUENCE_LENGTH, words: Words = word_tokens
) -> DataFrame:
    """One example per aspect row: id sequences of the conditioned text, mask, label and aspect id."""
    text = aspects.withColumn("_text", conditioned_text(F.col("aspect"), F.col("comment")))
    encoded = encode(text, "_text", vocabulary, prefix="_piece", length=length)
    return encoded.select(
        "review_id",
        aspect_index(F.col("aspect")).alias("aspect_idx"),
        F.col("sentiment_label").alias("label"),
        *feature_columns(
            char_ids(char_tokens(F.substring("_text", 1, length))),
            word_ids(words(_up_to(F.col("_text"), words, length))),
            F.col("_piece_ids"),
            length,
        ),
    )


def _up_to(text: Column, words: Words, length: int) -> Column:
    """As much of a text as holds its first words, where it is known what a word is."""
    return leading_words(text, length) if words is word_tokens else text


def corpus_features(
    research: DataFrame, vocabulary: DataFrame, length: int = SEQUENCE_LENGTH, words: Words = word_tokens, **corpus
) -> DataFrame:
    """``feature_rows`` of the aspect corpus, reading every comment once instead of once per aspect.

    Tokens never cross the space after the bracketed aspect, so the ids of ``[aspect] comment`` are those
    of the bracket followed by those of the comment. Comment ids are cut to ``length`` before the unpivot
    and the bracket's few characters are put in front afterwards.
    """
    reviews = research.withColumn("_text", F.coalesce("comment", F.lit("")))
    cut = encode(reviews, "_text", vocabulary, length=length).select(
        *research.columns,
        char_ids(char_tokens(F.substring("_text", 1, length))).alias("_chars"),
        word_ids(F.slice(words(_up_to(F.col("_text"), words, length)), 1, length)).alias("_words"),
        F.col("subword_ids").alias("_subwords"),
    )
    keep = ["review_id", "_chars", "_words", "_subwords"]
    rows = aspect_corpus(cut, keep=keep, **corpus)
    # Every aspect's bracket is encoded once; a column of the unpivot names one of these aspects.
    brackets = rows.sparkSession.createDataFrame([(a,) for a in ASPECTS], "aspect string").withColumn("_bracket", conditioned_text(F.col("aspect"), F.lit("")))
    bracket_ids = encode(brackets, "_bracket", vocabulary, prefix="bracket").select(
        "aspect",
        aspect_index(F.col("aspect")).alias("aspect_idx"),
        char_ids(char_tokens(F.col("_bracket"))).alias("_bracket_chars"),
        word_ids(words(F.col("_bracket"))).alias("_bracket_words"),
        "bracket_ids",
    )
    encoded = rows.join(F.broadcast(bracket_ids), "aspect")
    return encoded.select(
        "review_id",
        "aspect_idx",
        F.col("sentiment_label").alias("label"),
        *feature_columns(
            F.concat("_bracket_chars", "_chars"),
            F.concat("_bracket_words", "_words"),
            F.concat("bracket_ids", "_subwords"),
            length,
        ),
    )
