"""Trends kept up to date: a delivery rewrites the months it touches and those whose change refers to them, no others.

A level (over all hotels, or by hotel) is a folder of two Parquet trees with a part for each month and delivery, and a
manifest that names the delivery whose part holds each month::

    sums/delivery=3/year_month=2024-05     counts and sums of the month's groups
    trend/delivery=3/year_month=2024-05    the month's rows of the trend
    manifest/delivery=3                    month -> delivery, for both trees

Sums of a delivery are added to those stored for its months. A row of the trend changes if its month was touched for its
group, or if the month before it was, the one its change refers to; these rows are made anew from the sums of the touched
groups. A delivery counts once its manifest is there. The driver holds one entry a month of the calendar.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kuchikomi.domain import MIN_GROUP_REVIEWS
from kuchikomi.operators.trends import added_sums, from_sums, month_sums
from kuchikomi.session import fresh_path

MONTH = "year_month"
Parts = dict[str, dict[str, int]]


def manifest(spark: SparkSession, table: str) -> tuple[int, Parts]:
    """The newest complete delivery and, for both trees, the delivery that holds each month."""
    try:
        found = spark.read.schema("parts string, delivery bigint").parquet(f"{table}/manifest").orderBy(F.desc("delivery")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return (found.delivery, json.loads(found.parts)) if found else (0, {"sums": {}, "trend": {}})


def _months(spark: SparkSession, table: str, tree: str, parts: Parts, months=None) -> DataFrame | None:
    """The stored rows of the given months, or of all; None if there are none."""
    held = [(d, m) for m, d in sorted(parts[tree].items()) if months is None or m in months]
    if not held:
        return None
    paths = [f"{table}/{tree}/delivery={d}/{MONTH}={m}" for d, m in held]
    return spark.read.option("basePath", f"{table}/{tree}").option("mergeSchema", "false").parquet(*paths).withColumn(MONTH, F.col(MONTH).cast("string")).drop("delivery")


def _write(rows: DataFrame, table: str, tree: str, delivery: int) -> None:
    rows.repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(f"{table}/{tree}/delivery={delivery}")


def _listed(rows: DataFrame) -> list[str]:
    return sorted(r[MONTH] for r in rows.select(MONTH).distinct().collect())  # at most the months of the calendar


def update(new: DataFrame, table: str, by: tuple[str, ...] = (), min_reviews: int = MIN_GROUP_REVIEWS) -> list[str]:
    """Add the ``month_sums`` of a delivery to a level; returns the months whose trend was written."""
    spark = new.sparkSession
    last, parts = manifest(spark, table)
    path = fresh_path(spark, "month-sums")
    group = [*by, "aspect"]
    new.dropna(subset=[*group, MONTH]).write.parquet(path)
    new = spark.read.schema(new.schema).parquet(path)
    touched = _listed(new)
    if not touched:
        return []
    delivery, old = last + 1, _months(spark, table, "sums", parts, touched)
    _write(added_sums(new if old is None else new.unionByName(old), [*group, MONTH]), table, "sums", delivery)
    parts = {"sums": parts["sums"] | dict.fromkeys(touched, delivery), "trend": dict(parts["trend"])}

    # Rows that change, from all months of the groups touched.
    groups, hit = new.select(*group).distinct(), new.select(*group, MONTH).distinct().withColumn("_hit", F.lit(True))
    sums = _months(spark, table, "sums", parts).join(groups, group, "left_semi")
    months = Window.partitionBy(*group).orderBy(MONTH)
    made = from_sums(sums, by, min_reviews).join(hit, [*group, MONTH], "left")
    changed_path = fresh_path(spark, "changed-months")
    made.withColumn("_before", F.lag("_hit").over(months)).where("_hit or _before").drop("_hit", "_before").write.parquet(changed_path)
    changed = spark.read.parquet(changed_path)
    written = _listed(changed)
    if written:
        kept = _months(spark, table, "trend", parts, written)
        rows = changed if kept is None else changed.unionByName(kept.join(changed, [*group, MONTH], "left_anti"))
        _write(rows, table, "trend", delivery)
        parts["trend"] |= dict.fromkeys(written, delivery)
    text = spark.createDataFrame([(json.dumps(parts),)], "parts string")
    text.coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/delivery={delivery}")
    return written


def update_both_levels(aspects: DataFrame, table: str, min_reviews: int = MIN_GROUP_REVIEWS) -> None:
    """Add a delivery of aspect rows to the global and the hotel trend, from one pass over them."""
    path = fresh_path(aspects.sparkSession, "delivery-sums")
    month_sums(aspects, ("hotel_name",)).write.parquet(path)
    sums = aspects.sparkSession.read.parquet(path)
    update(added_sums(sums, [MONTH, "aspect"]), f"{table}/global", (), min_reviews)
    update(sums, f"{table}/hotel", ("hotel_name",), min_reviews)


def kept_trend(spark: SparkSession, table: str) -> DataFrame | None:
    """The trend of one level as it stands, or None before the first month has enough reviews."""
    return _months(spark, table, "trend", manifest(spark, table)[1])
