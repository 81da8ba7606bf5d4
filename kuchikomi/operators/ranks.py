"""Exact, reproducible random order without a single-task sort.

Rows are ordered by md5 of their key and a seed. The leading hexadecimal digits of the md5 name a bucket;
bucket sizes give every bucket its offset, and rows are sorted inside their bucket only. The result is the
rank a global window would give, at any skew of the strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kuchikomi.domain import SEED
from kuchikomi.functions.hashing import digest

# 4,096 buckets per stratum spread a rank; cuts sort one bucket per cut in one task, so theirs are finer.
BUCKET_DIGITS = 3
CUT_BUCKET_DIGITS = 4

_HASH, _BUCKET, _SIZE, _BEFORE, _PLACE = "_hash", "_bucket", "_size", "_before", "_place"


def seeded(key: Column, seed: int = SEED) -> Column:
    return digest(key, F.lit(seed))


def with_hash(
    df: DataFrame, key: str, strata: tuple[str, ...] = (), seed: int = SEED, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add the seeded md5 and the bucket: stratum values and leading digits in one text that is never null.

    A single non-null column lets the window, the size count and the join on the offsets all use the same
    partitioning and order.
    """
    stratum = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in strata]
    hashed = df.withColumn(_HASH, seeded(F.col(key), seed))
    return hashed.withColumn(_BUCKET, F.concat_ws("|", F.substring(_HASH, 1, digits), *stratum))


def bucket_sizes(hashed: DataFrame, strata: tuple[str, ...] = ()) -> DataFrame:
    """Rows per bucket with the rows before it in its stratum: at most 16^digits buckets per stratum."""
    sizes = hashed.groupBy(*strata, _BUCKET).agg(F.count(F.lit(1)).alias(_SIZE))
    earlier = Window.partitionBy(*strata).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(_BEFORE, F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0)))


def with_rank(
    df: DataFrame,
    key: str,
    strata: tuple[str, ...] = (),
    seed: int = SEED,
    rank: str = "rank",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add the 1-based rank of each row in its stratum, ordered by (md5 of key and seed, key).

    ``key`` identifies a row. The rank of a stratum with most of the rows is computed by as many tasks as
    there are buckets; the offsets join on the columns the rows are already partitioned by.
    """
    hashed = with_hash(df, key, strata, seed, digits)
    offsets = bucket_sizes(hashed, strata).select(_BUCKET, _BEFORE)
    inside = Window.partitionBy(_BUCKET).orderBy(_HASH, key)
    placed = hashed.withColumn(_PLACE, F.row_number().over(inside)).drop(_HASH)
    return placed.join(offsets, _BUCKET).select(*df.columns, (F.col(_BEFORE) + F.col(_PLACE)).alias(rank))


def order_key(key: Column, seed: int = SEED) -> Column:
    """One string per key that sorts as (md5, key): the md5 has fixed width."""
    return F.concat(seeded(key, seed), F.lit("|"), key.cast("string"))


def keys_at(
    ids: DataFrame,
    key: str,
    cuts: dict[str, Column],
    strata: tuple[str, ...] = (),
    seed: int = SEED,
    digits: int = CUT_BUCKET_DIGITS,
) -> DataFrame:
    """The order key found at given ranks of each stratum, one column per cut; null for rank 0.

    ``cuts`` maps names to rank expressions over ``total``, the size of the stratum. Only the buckets
    holding a cut are sorted; all others are just counted. One row per cut and stratum is broadcast, so the
    strata must come from a small fixed domain.
    """
    hashed = with_hash(ids, key, strata, seed, digits)
    whole = Window.partitionBy(*strata)
    sizes = bucket_sizes(hashed, strata).withColumn("total", F.sum(_SIZE).over(whole))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("cut"), c.cast("bigint").alias("at")) for n, c in cuts.items()]))
    holding = (
        sizes.select("*", wanted.alias("w"))
        .where((F.col("w.at") > F.col(_BEFORE)) & (F.col("w.at") <= F.col(_BEFORE) + F.col(_SIZE)))
        .select(*strata, _BUCKET, "w.cut", (F.col("w.at") - F.col(_BEFORE)).alias("at"))
    )
    inside = Window.partitionBy(_BUCKET).orderBy(_HASH, key)
    near = hashed.join(F.broadcast(holding.select(_BUCKET).distinct()), _BUCKET, "left_semi")
    placed = near.withColumn("at", F.row_number().over(inside).cast("bigint"))
    found = placed.join(F.broadcast(holding.drop(*strata)), [_BUCKET, "at"]).select(
        *strata, "cut", order_key(F.col(key), seed).alias("found")
    )
    return found.groupBy(*strata).agg(
        *[F.max(F.when(F.col("cut") == name, F.col("found"))).alias(name) for name in cuts]
    )
