"""Identical comments under different reviews, within and across hotels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.functions.text import preview
from kuchikomi.operators.collection import first_per_key

DIGEST = "comment_digest"


def _one_row_per_review(rows: DataFrame, key: str, order_by: list[str] | None, chars: int) -> DataFrame:
    """Hotel, comment digest and shortened comment of the first row per review; whole texts are not shuffled.

    Rows that are equal in all of this, as the aspects of a review are, become one by hash before anything is sorted.
    """
    order = order_by or ["hotel_name", DIGEST]
    digested = rows.withColumn(DIGEST, F.sha2(F.col("comment"), 256)).withColumn(
        "shown_comment", preview(F.col("comment"), chars)
    )
    needed = dict.fromkeys([key, "hotel_name", DIGEST, "shown_comment", *order])
    return first_per_key(digested.select(*needed).distinct(), key, order).where(F.col(DIGEST).isNotNull())


def repeated_comments(
    rows: DataFrame, key: str = "review_id", order_by: list[str] | None = None, chars: int = 50
) -> DataFrame:
    """Comments found under more than one review: digest, shortened text, number of reviews and of hotels.

    A null hotel counts as one hotel; null comments are not compared. Counts are first taken per comment
    and hotel, then per comment, so a comment shared by a third of all reviews arrives at its final task
    as one row per hotel and map task instead of one row per review.
    """
    per_hotel = (
        _one_row_per_review(rows, key, order_by, chars)
        .groupBy(DIGEST, "shown_comment", "hotel_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_comment = per_hotel.groupBy(DIGEST, "shown_comment").agg(
        F.sum("n").alias("n_reviews"), F.count(F.lit(1)).alias("n_hotels")
    )
    return per_comment.where(F.col("n_reviews") > 1)


def duplicate_summary(rows: DataFrame, key: str = "review_id", order_by: list[str] | None = None) -> DataFrame:
    """Number of repeated comments, and of those that cross hotels."""
    return repeated_comments(rows, key, order_by).agg(
        F.count(F.lit(1)).alias("repeated_comments"),
        F.count_if(F.col("n_hotels") > 1).alias("cross_hotel_comments"),
    )


def cross_hotel_examples(
    rows: DataFrame, key: str = "review_id", order_by: list[str] | None = None, examples: int = 5, chars: int = 50
) -> DataFrame:
    """The most repeated comments that cross hotels, one row per comment and hotel, comment shortened.

    The chosen digests, never more than ``examples``, are broadcast to find their hotels.
    """
    chosen = (
        repeated_comments(rows, key, order_by, chars)
        .where(F.col("n_hotels") > 1)
        .orderBy(F.desc("n_reviews"), DIGEST)
        .limit(examples)
    )
    hotels = _one_row_per_review(rows, key, order_by, chars).select(DIGEST, "hotel_name")
    return (
        hotels.join(F.broadcast(chosen), DIGEST)
        .select(DIGEST, F.col("shown_comment").alias("comment"), "n_reviews", "n_hotels", "hotel_name")
        .distinct()
    )
