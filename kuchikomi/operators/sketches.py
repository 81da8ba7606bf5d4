"""Figures that can be stored for small groups and merged for larger ones, beside the exact ones of ``audit``.

A sketch is a few kilobytes whatever the number of rows, so a table of sketches per hotel and month answers for a hotel, a
split or the whole corpus without reading a text again. Both kinds are estimates with a stated bound: quantiles are off by
at most ``RANK_ERROR`` in rank, distinct counts by ``DISTINCT_ERROR`` of the count, each in all but about one of a
hundred cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.functions.hashing import compact
from kuchikomi.functions.text import char_length
from kuchikomi.operators.audit import PERCENTILES

KLL_K, RANK_ERROR = 800, 0.005
HLL_BITS, DISTINCT_ERROR = 14, 0.02


def length_sketches(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """For each group the number of texts, the shortest and longest, and a sketch of their lengths; nulls don't count."""
    chars = df.select(*by, char_length(F.col(column)).alias("chars")).where(F.col("chars").isNotNull())
    return chars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.kll_sketch_agg_bigint("chars", KLL_K).alias("lengths")
    )


def merged_lengths(stored: DataFrame, by: list[str]) -> DataFrame:
    """``length_sketches`` of larger groups from those of smaller ones."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("min_chars").alias("min_chars"), F.max("max_chars").alias("max_chars"), F.kll_merge_agg_bigint("lengths", KLL_K).alias("lengths")
    )


def length_quantiles(stored: DataFrame, shares: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """A length for each share of the texts, one column each; shortest and longest are exact."""
    kept = [c for c in stored.columns if c != "lengths"]
    found = [F.kll_sketch_get_quantile_bigint("lengths", F.lit(p)).alias(f"p{round(p * 100)}") for p in shares]
    return stored.select(*kept, *found)


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """For each group a sketch of the distinct values of each column; long texts stand for themselves by a digest."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(compact(F.col(c)), HLL_BITS).alias(c) for c in columns])


def merged_distinct(stored: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``distinct_sketches`` of larger groups: a value of several smaller groups counts once."""
    return stored.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in columns])


def distinct_estimates(stored: DataFrame, columns: list[str]) -> DataFrame:
    """The estimated number of distinct values of each column."""
    return stored.select(*[F.hll_sketch_estimate(c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def ids_against_texts(stored: DataFrame, ids: str, texts: str) -> DataFrame:
    """Estimated distinct ids and texts of each group, and what they tell within the bound."""
    found = distinct_estimates(stored, [ids, texts])
    margin = F.greatest(F.col(ids), F.col(texts)) * 2 * DISTINCT_ERROR
    gap = F.col(ids) - F.col(texts)
    verdict = F.when(F.abs(gap) <= margin, "about one text per id").when(gap > 0, "texts repeat across ids").otherwise("ids repeat across texts")
    return found.withColumn("verdict", verdict)
