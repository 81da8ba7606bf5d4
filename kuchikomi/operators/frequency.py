"""Frequency tables, shares, contingency and value samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS
from kuchikomi.functions.scores import percent, shown_percent


def frequencies(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """Occurrences of each value, nulls dropped unless asked for."""
    counted = df if keep_null else df.where(F.col(column).isNotNull())
    return counted.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def counts_of_domain(column: str, values: tuple) -> dict[str, Column]:
    """Aggregates that count each value of a fixed domain, for a pass that does something else."""
    return {f"{column}_{i}": F.count_if(F.col(column) == v) for i, v in enumerate(values)}


def domain_frequencies(spark: SparkSession, column: str, values: tuple, counts: dict) -> DataFrame:
    """The table ``frequencies`` gives, from what ``counts_of_domain`` found; values that don't occur are left out."""
    kind = "int" if all(isinstance(v, int) for v in values) else "string"
    rows = [(v, counts[f"{column}_{i}"]) for i, v in enumerate(values) if counts.get(f"{column}_{i}")]
    return spark.createDataFrame(rows, f"{column} {kind}, n bigint")


def by_count(table: DataFrame) -> DataFrame:
    """A frequency table, most frequent first, ties by value."""
    value = table.columns[0]
    return table.orderBy(F.desc("n"), F.asc_nulls_last(value))


def by_value(table: DataFrame) -> DataFrame:
    return table.orderBy(F.asc_nulls_last(table.columns[0]))


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery, usable in any expression without a join."""
    return df.agg(F.count(F.lit(1))).scalar()


def shares(df: DataFrame, column: str, of_all_rows: bool = False) -> DataFrame:
    """Frequencies with their percentage of the non-null values, or of all rows."""
    table = frequencies(df, column)
    # The total of the table itself, so that both read one aggregation; all rows need a count of their own.
    total = row_count(df.select(column)) if of_all_rows else table.agg(F.sum("n")).scalar()
    return shares_of(table, column, total)


def shares_of(table: DataFrame, column: str, total: Column) -> DataFrame:
    """The same from frequencies and the number they are a part of."""
    return table.select(
        column,
        "n",
        percent(F.col("n"), total).alias("pct"),
        shown_percent(F.col("n"), total).alias("pct_shown"),
    )


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts for each pair of values that occurs; rows with a null in either key are dropped."""
    return df.dropna(subset=[rows, columns]).groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """The contingency table with one column per listed value and zeros filled in."""
    counts = [F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values]
    return df.dropna(subset=[rows, columns]).groupBy(rows).agg(*counts)


def score_distribution(flat: DataFrame) -> DataFrame:
    """Occurrences of each score per aspect, nulls kept: one pass over the flattened corpus."""
    present = [a for a in ASPECTS if a in flat.columns]
    long = flat.select(*present).unpivot([], present, "aspect", "score")
    return long.groupBy("aspect", "score").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The set of values, null included."""
    return df.select(column).distinct()


def value_samples(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` distinct values, by value, of every column as text; null is a value, the last one.

    All columns share the scan. Copies of a value are reduced in every map task, and so are the distinct ones
    after them: the constant bound on the rank lets each task keep the first ``n`` of a column.
    """
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    values = as_text.unpivot([], list(df.columns), "column_name", "value").distinct()
    by_value = Window.partitionBy("column_name").orderBy(F.asc_nulls_last("value"))
    return values.withColumn("place", F.row_number().over(by_value)).where(F.col("place") <= n)
