"""Data-quality audits. Each is one aggregation over the table, however many figures it reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS, MIN_COMMENT_CHARS
from kuchikomi.functions.hashing import compact
from kuchikomi.functions.scores import percent
from kuchikomi.functions.text import char_length, strip, stripped_length
from kuchikomi.functions.time import parse_lenient

PERCENTILES = (0.25, 0.50, 0.75, 0.90, 0.99)


def _rows() -> Column:
    return F.count(F.lit(1))


def _compacted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with long texts replaced by digests; other types are kept."""
    types = dict(df.dtypes)
    return df.select(*[compact(F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in columns])


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls of every column, one row per column, counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], list(df.columns), "column_name", "nulls")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values of each column; exact, or HyperLogLog for a quick look at a large table."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    counted = _compacted(df, columns).agg(*[count(c).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "distinct_values")


def repeated_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows minus distinct values per column, null counting as one value."""
    counted = _compacted(df, columns).agg(
        *[
            (_rows() - F.count_distinct(c) - F.max(F.col(c).isNull().cast("bigint"))).alias(c)
            for c in columns
        ]
    )
    return counted.unpivot([], columns, "column_name", "repeated")


def repeated_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in all columns."""
    groups = _compacted(df, df.columns).groupBy(*df.columns).agg(_rows().alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"))


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Texts per length. Later statistics run on this table, which is as small as the longest text."""
    lengths = df.select(char_length(F.col(column)).alias("chars")).where(F.col("chars").isNotNull())
    return lengths.groupBy("chars").agg(_rows().alias("n"))


def length_summary(df: DataFrame, column: str) -> DataFrame:
    """Shortest, longest, mean and median length in characters."""
    return length_histogram(df, column).agg(
        F.min("chars").alias("min_chars"),
        F.max("chars").alias("max_chars"),
        (F.sum(F.col("chars") * F.col("n")) / F.sum("n")).alias("mean_chars"),
        F.percentile("chars", F.lit(0.5), F.col("n")).alias("median_chars"),
    )


def length_description(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles of the length, as (statistic, value)."""
    histogram = length_histogram(df, column)
    n, x = F.col("n").cast("double"), F.col("chars").cast("double")
    mean = F.sum(n * x) / F.sum(n)
    squares = F.sum(n * x * x) - F.sum(n * x) * mean
    figures = {
        "count": F.sum(n),
        "mean": mean,
        "std": F.sqrt(F.try_divide(F.greatest(squares, F.lit(0.0)), F.sum(n) - 1)),
        "min": F.min(x),
        **{f"p{round(p * 100)}": F.percentile("chars", F.lit(p), F.col("n")) for p in PERCENTILES},
        "max": F.max(x),
    }
    wide = histogram.agg(*[f.alias(name) for name, f in figures.items()])
    return wide.unpivot([], list(figures), "statistic", "value")


def empty_texts(df: DataFrame, column: str) -> DataFrame:
    """Texts that are empty once stripped."""
    return df.agg(F.count_if(strip(F.col(column)) == "").alias("empty_texts"))


def temporal_coverage(df: DataFrame, posted: str = "post_datetime", check_in: str = "check_in_date") -> DataFrame:
    """Earliest and latest post time, missing or invalid post times, missing check-in dates."""
    instant = parse_lenient(F.col(posted))
    return df.agg(
        F.min(instant).alias("first_post"),
        F.max(instant).alias("last_post"),
        F.count_if(instant.isNull()).alias("missing_or_invalid"),
        F.count_if(F.col(check_in).isNull()).alias("check_in_missing"),
    )


def date_facts(posted: str = "post_datetime", hotel: str = "hotel_name") -> list[Column]:
    """The aggregates of ``date_audit``."""
    nulls = F.count_if(F.col(posted).isNull())
    malformed = F.count_if(F.col(posted).isNotNull() & parse_lenient(F.col(posted)).isNull())
    no_hotel = F.count_if(F.col(hotel).isNull())
    return [
        _rows().alias("total_rows"),
        nulls.alias("null_dates"),
        percent(nulls, _rows()).alias("null_dates_pct"),
        malformed.alias("malformed_dates"),
        percent(malformed, _rows()).alias("malformed_dates_pct"),
        no_hotel.alias("null_hotels"),
        percent(no_hotel, _rows()).alias("null_hotels_pct"),
    ]


def date_audit(df: DataFrame, posted: str = "post_datetime", hotel: str = "hotel_name") -> DataFrame:
    """Null and malformed post times and null hotel names, each with its percentage of all rows."""
    return df.agg(*date_facts(posted, hotel))


def text_facts(column: str = "comment", short: int = MIN_COMMENT_CHARS) -> list[Column]:
    """The aggregates of ``missing_texts``, but for the number of rows."""
    text = F.col(column)
    missing = F.count_if(text.isNull() | (strip(text) == ""))
    brief = F.count_if(stripped_length(text) < short)
    return [
        missing.alias("null_or_empty"),
        percent(missing, _rows()).alias("null_or_empty_pct"),
        brief.alias("short_with_empty"),
        percent(brief, _rows()).alias("short_with_empty_pct"),
    ]


def missing_texts(df: DataFrame, column: str = "comment", short: int = MIN_COMMENT_CHARS) -> DataFrame:
    """Null or empty texts and short texts with percentages; the short ones include the empty ones."""
    return df.agg(_rows().alias("total_rows"), *text_facts(column, short))


def ids_against_texts(df: DataFrame, key: str = "review_id", text: str = "comment") -> DataFrame:
    """Distinct ids and texts, their difference and what it says. Texts are compared by SHA-256."""
    counted = df.select(key, F.sha2(F.col(text), 256).alias("text_digest")).agg(
        F.count_distinct(key).alias("unique_ids"), F.count_distinct("text_digest").alias("unique_texts")
    )
    ids, texts = F.col("unique_ids"), F.col("unique_texts")
    return counted.select(
        "unique_ids",
        "unique_texts",
        F.abs(ids - texts).alias("difference"),
        F.when(texts < ids, "texts repeat across ids")
        .when(texts == ids, "one text per id")
        .otherwise("ids repeat across texts")
        .alias("verdict"),
    )


def aspect_nulls(aspects: DataFrame) -> DataFrame:
    """Null scores and labels per aspect, with percentages."""
    no_score = F.count_if(F.col("score").isNull())
    no_label = F.count_if(F.col("sentiment_label").isNull())
    return (
        aspects.where(F.col("aspect").isNotNull())
        .groupBy("aspect")
        .agg(
            _rows().alias("n"),
            no_score.alias("null_scores"),
            percent(no_score, _rows()).alias("null_scores_pct"),
            no_label.alias("null_labels"),
            percent(no_label, _rows()).alias("null_labels_pct"),
        )
    )


def domain_check(df: DataFrame, column: str = "aspect", expected: tuple[str, ...] = ASPECTS) -> DataFrame:
    """Every expected or found value, its rows and where it stands: ok, missing or unexpected.

    The verdict on the whole column is ``matches``: true when no value is missing or unexpected.
    """
    return domain_standing(df.where(F.col(column).isNotNull()).groupBy(column).agg(_rows().alias("n")), column, expected)


def domain_standing(found: DataFrame, column: str = "aspect", expected: tuple[str, ...] = ASPECTS) -> DataFrame:
    """The same from rows already counted as ``n``."""
    wanted = found.sparkSession.createDataFrame([(v,) for v in expected], f"{column} string")
    compared = found.join(wanted.withColumn("wanted", F.lit(True)), column, "full_outer").select(
        column,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").otherwise("ok").alias("standing"),
    )
    problems = compared.where(F.col("standing") != "ok").agg(F.count(F.lit(1)))
    return compared.withColumn("matches", problems.scalar() == 0)
