"""From raw reviews to the research corpus and the aspect corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS, MIN_COMMENT_CHARS
from kuchikomi.functions.scores import aspect_score, score_map, sentiment
from kuchikomi.functions.text import clean_text, stripped_length

REVIEW_COLUMNS = ("hotel_id", "hotel_name", "review_id", "comment", "post_datetime")


def research_corpus(reviews: DataFrame, source: str) -> DataFrame:
    """Flatten raw reviews to one record each: cleaned text, nested names pulled up, scores as a map."""
    return reviews.select(
        "hotel_id",
        F.col("id").alias("review_id"),
        F.col("provider.name").alias("hotel_name"),
        clean_text(F.col("title")).alias("title"),
        clean_text(F.col("comment")).alias("comment"),
        F.col("overallScore").alias("overall_score"),
        F.col("postDateTime").alias("post_datetime"),
        F.col("reservation.checkInDate").alias("check_in_date"),
        score_map(F.col("scores")).alias("scores"),
        F.lit(source).alias("source"),
    )


def flatten_scores(research: DataFrame) -> DataFrame:
    """Replace the score map by one column per aspect, named after the aspect."""
    kept = [c for c in research.columns if c != "scores"]
    return research.select(*kept, *[aspect_score(F.col("scores"), a).alias(a) for a in ASPECTS])


def usable_comments(reviews: DataFrame, min_chars: int = MIN_COMMENT_CHARS) -> DataFrame:
    """Reviews whose stripped comment has at least ``min_chars`` characters."""
    return reviews.where(stripped_length(F.col("comment")) >= min_chars)


def unpivot_aspects(flat: DataFrame, keep: list[str]) -> DataFrame:
    """One row per review and aspect column present, null scores included."""
    present = [a for a in ASPECTS if a in flat.columns]
    return flat.select(*keep, *present).unpivot(keep, present, "aspect", "score")


def rated(aspects: DataFrame) -> DataFrame:
    """Rows with a real score: 0, null and NaN mean unrated."""
    return aspects.where((F.col("score") > 0.0) & ~F.isnan("score"))


def with_sentiment(aspects: DataFrame) -> DataFrame:
    return aspects.withColumn("sentiment_label", sentiment(F.col("score")))


def in_reading_order(reviews: DataFrame) -> DataFrame:
    """Reviews by hotel, then post time, nulls last. For a sink, not between steps."""
    return reviews.orderBy(F.asc_nulls_last("hotel_id"), F.asc_nulls_last("post_datetime"), "review_id")


def aspect_corpus(
    research: DataFrame,
    required_aspect: str | None = ASPECTS[0],
    min_chars: int | None = MIN_COMMENT_CHARS,
    keep: list[str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """The labelled aspect corpus: filter reviews, unpivot the aspects, drop unrated ones, label.

    A review whose ``required_aspect`` has no score is dropped with all its aspects. Scan to result is
    one stage without a shuffle; columns nobody asks for are pruned at the scan. ``ordered`` sorts the
    reviews before the unpivot, which keeps their order and puts aspects in id order: an eighth of the
    rows, and of the comments, that sorting the result would move.
    """
    keep = list(REVIEW_COLUMNS) if keep is None else keep
    reviews = research if min_chars is None else usable_comments(research, min_chars)
    flat = flatten_scores(reviews)
    if required_aspect is not None:
        flat = flat.where(F.col(required_aspect).isNotNull())
    if ordered:
        flat = in_reading_order(flat)
    return with_sentiment(rated(unpivot_aspects(flat, keep)))
