"""Audit of stored tables: do they exist, what do they hold."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECT_COLUMN_KEYWORDS, HOTEL_COLUMN_KEYWORDS
from kuchikomi.functions.text import preview


def columns_matching(df: DataFrame, keywords: tuple[str, ...]) -> list[str]:
    """Column names containing any keyword, in any case; reads the schema only."""
    wanted = re.compile("|".join(map(re.escape, keywords)), re.IGNORECASE)
    return list(filter(wanted.search, df.schema.fieldNames()))


def open_asset(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table at ``path``, or None when nothing is stored there."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def asset_overview(spark: SparkSession, assets: dict[str, str], fmt: str = "parquet", **options) -> DataFrame:
    """One row per asset: found or not, shape, column names, aspect-like and hotel-like columns."""
    parts = []
    for name, path in assets.items():
        df = open_asset(spark, path, fmt, **options)
        rows = spark.range(1).select(F.lit(0).cast("bigint").alias("n_rows")) if df is None else df.agg(
            F.count(F.lit(1)).alias("n_rows")
        )
        names = [] if df is None else df.columns
        parts.append(
            rows.select(
                F.lit(name).alias("asset"),
                F.lit(df is not None).alias("found"),
                "n_rows",
                F.lit(len(names)).cast("bigint").alias("n_columns"),
                F.lit(", ".join(names)).alias("column_names"),
                F.lit(", ".join([] if df is None else columns_matching(df, ASPECT_COLUMN_KEYWORDS))).alias("aspect_columns"),
                F.lit(", ".join([] if df is None else columns_matching(df, HOTEL_COLUMN_KEYWORDS))).alias("hotel_columns"),
            )
        )
    return _stacked(parts)


def asset_labels(
    spark: SparkSession, assets: dict[str, str], label: str = "label", fmt: str = "parquet", **options
) -> DataFrame:
    """Label distribution of every asset that has the label column."""
    parts = []
    for name, path in assets.items():
        df = open_asset(spark, path, fmt, **options)
        if df is not None and label in df.columns:
            counted = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label"))
            parts.append(counted.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asset"), "label", "n"))
    if not parts:
        return spark.createDataFrame([], "asset string, label string, n bigint")
    return _stacked(parts)


def sample_row(df: DataFrame, order_by: str, chars: int = 100) -> DataFrame:
    """The first row by ``order_by`` as (column, value) pairs, long values shortened."""
    first = df.orderBy(F.asc_nulls_last(order_by)).limit(1)
    as_text = first.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    long = as_text.unpivot([], list(df.columns), "column_name", "value")
    return long.select("column_name", preview(F.col("value"), chars).alias("value"))


def overview(df: DataFrame) -> DataFrame:
    """Row and column count, and each column's name and type, one row per column."""
    described = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("data_type"))
                for i, (n, t) in enumerate(df.dtypes)
            ]
        )
    )
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), described.alias("c")).select(
        "n_rows", "n_columns", "c.*"
    )
