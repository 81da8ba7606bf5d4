"""Writers. Tables passed between jobs are better kept as Parquet; these are the exchange formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kuchikomi.domain import NULL_TEXT


def append_json(df: DataFrame, path: str) -> None:
    """Add JSON lines (unescaped UTF-8) to a table."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replace a table of JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, split_column: str | None = None, sep: str = ",", header: bool = True, null_text: str = NULL_TEXT) -> None:
    """Replace a delimited table; with ``split_column`` one folder per split.

    Texts keep blanks at both ends, an empty text is written as two quotes and null as ``null_text``.
    """
    writer = (
        df.write.mode("overwrite")
        .option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null_text)
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if split_column:
        writer = writer.partitionBy(split_column)
    writer.csv(path)


def write_tsv(df: DataFrame, path: str, null_text: str = NULL_TEXT) -> None:
    """Replace a tab-separated table without header."""
    write_csv(df, path, sep="\t", header=False, null_text=null_text)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """Replace a plain-text table, one document per line; null is written as an empty line."""
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def append_text(df: DataFrame, column: str, path: str, split_column: str) -> None:
    """Add lines to plain-text tables, one folder per value of ``split_column``."""
    df.select(F.col(column).alias("value"), split_column).write.mode("append").partitionBy(split_column).text(path)


def write_counted(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Replace a Parquet table and return aggregates of the rows written, taken while they are written."""
    counted = Observation()
    write_parquet(df.observe(counted, *[m.alias(name) for name, m in metrics.items()]), path)
    return counted.get


def write_parquet(df: DataFrame, path: str, split_column: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if split_column:
        writer = writer.partitionBy(split_column)
    writer.parquet(path)
