"""Monthly trends per aspect, overall and per hotel, with period-over-period change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kuchikomi.domain import MIN_GROUP_REVIEWS
from kuchikomi.functions.time import month_of, month_start, parse_strict


def with_month(rows: DataFrame) -> DataFrame:
    """Add the UTC calendar month of ``post_datetime``; a malformed time fails the job.

    Taken on reviews, before the unpivot, it is computed once instead of once per aspect.
    """
    return rows.withColumn("year_month", month_of(parse_strict(F.col("post_datetime"))))


def trend(aspects: DataFrame, by: tuple[str, ...] = (), min_reviews: int = MIN_GROUP_REVIEWS) -> DataFrame:
    """Review count, mean score and mean sentiment per month and aspect (and ``by``), with deltas.

    Rows with a null key are dropped. Small groups are dropped before the deltas are taken, so a delta
    compares with the previous month that was kept. The window runs over aggregated months only: its
    groups are as long as the calendar, whatever the number of reviews.
    """
    return from_sums(month_sums(aspects, by), by, min_reviews)


def month_sums(aspects: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums per month and aspect (and ``by``, where null is a value), from which trends are made."""
    if "year_month" not in aspects.columns:
        # A strictly parsed time is null only where the text is, so the text is tested instead.
        aspects = with_month(aspects.where(F.col("post_datetime").isNotNull()))
    return aspects.dropna(subset=["year_month", "aspect"]).groupBy(*by, "year_month", "aspect").agg(
        F.count("review_id").alias("review_count"),
        F.count("score").alias("scores"),
        F.sum("score").alias("score_sum"),
        F.count("sentiment_label").alias("labels"),
        F.sum("sentiment_label").alias("label_sum"),
    )


SUMS = ("review_count", "scores", "score_sum", "labels", "label_sum")


def added_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """Sums of sums, for fewer columns or of several tables."""
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def from_sums(sums: DataFrame, by: tuple[str, ...], min_reviews: int) -> DataFrame:
    """The trend made from ``month_sums``."""
    keys = [*by, "year_month", "aspect"]
    grouped = sums.dropna(subset=keys).where(F.col("review_count") >= min_reviews).select(
        *keys,
        "review_count",
        F.try_divide("score_sum", "scores").alias("avg_score"),
        F.try_divide("label_sum", "labels").alias("avg_sentiment"),
    )
    months = Window.partitionBy(*by, "aspect").orderBy("year_month")
    return grouped.select(
        *keys,
        "review_count",
        "avg_score",
        "avg_sentiment",
        (F.col("avg_score") - F.lag("avg_score").over(months)).alias("score_delta"),
        (F.col("avg_sentiment") - F.lag("avg_sentiment").over(months)).alias("sentiment_delta"),
    )


def global_trend(aspects: DataFrame, min_reviews: int = MIN_GROUP_REVIEWS) -> DataFrame:
    return trend(aspects, (), min_reviews)


def hotel_trend(aspects: DataFrame, min_reviews: int = MIN_GROUP_REVIEWS) -> DataFrame:
    return trend(aspects, ("hotel_name",), min_reviews)


def trends_of_both_levels(aspects: DataFrame, min_reviews: int = MIN_GROUP_REVIEWS) -> tuple[DataFrame, DataFrame]:
    """The global and the hotel trend from one pass: sums per hotel are rolled up, rows without a hotel included.

    The sums, a row per hotel, month and aspect, are kept for the caller to unpersist with the second result.
    """
    sums = month_sums(aspects, ("hotel_name",)).persist()
    overall = added_sums(sums, ["year_month", "aspect"])
    return from_sums(overall, (), min_reviews), from_sums(sums, ("hotel_name",), min_reviews)


def in_trend_order(trends: DataFrame) -> DataFrame:
    """Sorted by hotel (if any), aspect and month, for a sink."""
    keys = [c for c in ("hotel_name", "aspect", "year_month") if c in trends.columns]
    return trends.orderBy(*keys)


def top_movers(trends: DataFrame, rises: bool = True, n: int = 3) -> DataFrame:
    """The largest rises or falls of the score; earlier (hotel, aspect, month) wins a tie, nulls fill up."""
    first = F.desc_nulls_last("score_delta") if rises else F.asc_nulls_last("score_delta")
    keys = [c for c in ("hotel_name", "aspect", "year_month") if c in trends.columns]
    return trends.orderBy(first, *keys).limit(n)


def chart_series(trends: DataFrame) -> DataFrame:
    """The points of the score chart: first day of the month, aspect, mean score."""
    return trends.select(month_start(F.col("year_month")).alias("date"), "aspect", "avg_score")
