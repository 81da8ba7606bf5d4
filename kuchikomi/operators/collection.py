"""Collecting reviews page by page: first-seen deduplication, resuming, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kuchikomi.functions.text import filled

# Bits of one bitmap, as Spark's bitmap functions make them, and bitmaps that mark repeated keys: 4 KB each, 4 MB together.
BITMAP_BITS = 32_768
REPEATED_BITMAPS = 1_024


def identified(reviews: DataFrame, id_column: str = "id") -> DataFrame:
    """Reviews with an id, the id as string; null and empty ids are missing."""
    return reviews.withColumn(id_column, F.col(id_column).cast("string")).where(filled(F.col(id_column)))


def first_per_key(df: DataFrame, key: str | list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key by ``order_by``; null keys form one group.

    The bound on the rank lets every map task keep its first row of a key before the shuffle, so the copies of
    a hot key never meet in one task, and no row passes through an aggregation buffer. ``order_by`` should
    identify a row, otherwise ties are settled by a hash of all columns.
    """
    tie = F.xxhash64(*df.columns)
    order = Window.partitionBy(key).orderBy(*order_by, tie)
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1).drop("_place")


def key_hash(key: list[str]) -> Column:
    """64 bits that stand for a key; a null differs from every text."""
    return F.xxhash64(*[part for c in key for part in (F.col(c).isNull(), F.col(c))])


def bit_is_set(bitmap: Column, position: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` has the bit, counted from 0; a missing bitmap has none."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0, F.lit(False))


def first_of_key(df: DataFrame, key: list[str], order_by: list[str]) -> DataFrame:
    """The rows of ``first_per_key`` without moving those whose key occurs once.

    ``df`` should be stored: it is read three times, the first time only in its key. Hashes of keys that occur more than
    once, found on eight bytes a row, are marked in bitmaps of a fixed size, which are broadcast. Rows without a mark pass
    where they lie; only marked ones, and the few whose hash shares a mark, are moved and ranked.
    """
    marked = F.pmod(F.col("_key"), F.lit(REPEATED_BITMAPS * BITMAP_BITS))
    block, bit = F.floor(marked / BITMAP_BITS).cast("int"), (marked % BITMAP_BITS).cast("int")
    hashed = df.withColumn("_key", key_hash(key))
    repeated = hashed.select("_key").groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bitmaps = repeated.select(block.alias("_block"), bit.alias("bit")).groupBy("_block").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    flagged = (
        hashed.withColumn("_block", block)
        .join(F.broadcast(bitmaps), "_block", "left")
        .withColumn("_again", bit_is_set(F.col("_bits"), bit))
    )
    once = flagged.where(~F.col("_again")).select(*df.columns)
    return once.unionByName(first_per_key(flagged.where("_again").select(*df.columns), key, order_by))


def not_yet_collected(reviews: DataFrame, stored_ids: DataFrame, id_column: str | list[str] = "review_id") -> DataFrame:
    """Reviews whose id is not stored; with several columns, nulls equal nulls.

    Both sides can be large, so the join strategy is left to AQE.
    """
    if isinstance(id_column, str):
        return reviews.join(stored_ids.select(id_column), id_column, "left_anti")
    known = stored_ids.select(*[F.col(c).alias(f"_{c}") for c in id_column])
    same = [reviews[c].eqNullSafe(known[f"_{c}"]) for c in id_column]
    return reviews.join(known, same, "left_anti")


def reconciliation(reviews: DataFrame, totals: DataFrame, by: str = "hotel_id") -> DataFrame:
    """Per hotel: unique reviews held, total the site reports, and how many are still missing."""
    held = reviews.groupBy(by).agg(F.count_distinct("review_id").alias("unique_reviews"))
    reported = totals.groupBy(by).agg(F.max("reported_total").alias("reported_total"))
    return reported.join(held, by, "left").select(
        by,
        F.coalesce("unique_reviews", F.lit(0)).cast("bigint").alias("unique_reviews"),
        "reported_total",
        F.greatest(F.col("reported_total") - F.coalesce("unique_reviews", F.lit(0)), F.lit(0)).cast("bigint").alias("remaining"),
    )
