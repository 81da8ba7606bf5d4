"""Monthly trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kuchikomi.functions.time import month_of, parse_strict
from kuchikomi.operators import trends
from kuchikomi.plans import views
from kuchikomi.plans.catalogue.registry import query
from kuchikomi.session import fresh_path
from kuchikomi.streaming import trend_table


def _trend_sql(by: str) -> str:
    keys = f"{by}year_month, aspect"
    not_null = "where hotel_name is not null" if by else ""
    return f"""
months as (select *, strftime(post_utc, '%Y-%m') as year_month from rated_rows),
grouped as (
  select {keys}, count(review_id) as review_count, avg(score) as avg_score, avg(sentiment_label) as avg_sentiment
  from months {not_null} group by {keys} having count(review_id) >= 5),
trend as (
  select *, avg_score - lag(avg_score) over w as score_delta, avg_sentiment - lag(avg_sentiment) over w as sentiment_delta
  from grouped window w as (partition by {by}aspect order by year_month))
"""


GLOBAL_SQL = _trend_sql("")
HOTEL_SQL = _trend_sql("hotel_name, ")


@query("A9 W1 F5 P11 P13 T2 (on F2 F3 P6 P8)", "select * from trend", (views.REVIEWS_SQL, GLOBAL_SQL))
def global_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.in_trend_order(trends.global_trend(views.rated_rows(spark, sf_dir, months=True)))


@query("A10 W2 F5 T2", "select * from trend", (views.REVIEWS_SQL, HOTEL_SQL))
def hotel_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.in_trend_order(trends.hotel_trend(views.rated_rows(spark, sf_dir, months=True)))


_BOTH_SQL = f"""
    , {GLOBAL_SQL.strip().replace("months as", "all_months as").replace("from months", "from all_months").replace("grouped", "all_grouped").replace("trend as", "all_trend as")},
    {HOTEL_SQL.strip()}
    select null as hotel_name, * from all_trend union all by name select * from trend"""


@query("A9 A10 W1 W2 (one scan)", _BOTH_SQL, (views.REVIEWS_SQL,))
def trends_both_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global and the hotel trend from the same sums."""
    overall, hotels = trends.trends_of_both_levels(views.rated_rows(spark, sf_dir, months=True))
    return overall.withColumn("hotel_name", F.lit(None).cast("string")).unionByName(hotels)


@query("A9 A10 W1 W2 (kept up to date)", _BOTH_SQL, (views.REVIEWS_SQL,))
def trends_after_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both trends after three deliveries: most reviews, those of one year that were left out, and all others."""
    path = fresh_path(spark, "trends")
    rows = views.rated_rows(spark, sf_dir, months=True)
    late, year = F.xxhash64("review_id") % 5 == 0, F.col("year_month").startswith("1995")
    for delivery in (rows.where(~late), rows.where(late & year), rows.where(late & ~year)):
        trend_table.update_both_levels(delivery, path)
    overall, hotels = (trend_table.kept_trend(spark, f"{path}/{level}") for level in ("global", "hotel"))
    return overall.withColumn("hotel_name", F.lit(None).cast("string")).unionByName(hotels)


_MOVERS = "select * from trend order by score_delta {} nulls last, aspect, year_month limit 3"


@query("T3", _MOVERS.format("desc"), (views.REVIEWS_SQL, GLOBAL_SQL))
def top_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_movers(trends.global_trend(views.rated_rows(spark, sf_dir, months=True)), rises=True)


@query("T4", _MOVERS.format("asc"), (views.REVIEWS_SQL, GLOBAL_SQL))
def top_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_movers(trends.global_trend(views.rated_rows(spark, sf_dir, months=True)), rises=False)


@query(
    "P14",
    "select year_month || '-01' as date, aspect, avg_score from trend",
    (views.REVIEWS_SQL, GLOBAL_SQL),
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = trends.chart_series(trends.global_trend(views.rated_rows(spark, sf_dir, months=True)))
    return points.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "A9 W1 on the largest table",
    """
    with months as (select strftime(l_shipdate, '%Y-%m') as year_month, l_returnflag as aspect, l_quantity from lineitem),
    grouped as (
      select year_month, aspect, count(*) as review_count, round(avg(l_quantity), 6) as avg_score
      from months group by year_month, aspect having count(*) >= 5)
    select *, round(avg_score - lag(avg_score) over (partition by aspect order by year_month), 6) as score_delta
    from grouped""",
)
def shipment_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend operator over order lines: return flags as aspects, quantities as scores."""
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("review_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("post_datetime"),
        F.col("l_returnflag").alias("aspect"),
        F.col("l_quantity").alias("score"),
        F.lit(0).alias("sentiment_label"),
    )
    trend = trends.global_trend(lines)
    rounded = F.round("avg_score", 6)
    # Deltas of the rounded means, so that both engines subtract the same numbers.
    window = Window.partitionBy("aspect").orderBy("year_month")
    return trend.select(
        "year_month",
        "aspect",
        "review_count",
        rounded.alias("avg_score"),
        F.round(rounded - F.lag(rounded).over(window), 6).alias("score_delta"),
    )


@query(
    "P11 P13",
    "select review_id, strftime(post_utc, '%Y-%m') as year_month from reviews",
    (views.REVIEWS_SQL,),
)
def review_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = month_of(parse_strict(F.col("post_datetime")))
    return views.reviews(spark, sf_dir).select("review_id", months.alias("year_month"))
