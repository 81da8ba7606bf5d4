"""Train, validation and test splits that keep reviews or hotels together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuchikomi.domain import LABELS, PREASSIGNED_SPLITS, SEED, TEST, TRAIN, UNKNOWN_HOTEL, VALIDATION
from kuchikomi.functions.scores import percent
from kuchikomi.operators.ranks import keys_at, order_key

HELD_OUT = 0.2
TEST_OF_HELD_OUT = 0.5


def _held_out(total: Column, share: float = HELD_OUT) -> Column:
    return F.ceil(F.lit(share) * total)


def with_known_hotels(df: DataFrame, column: str = "hotel_name") -> DataFrame:
    """Null hotel names become one named group."""
    return df.fillna({column: UNKNOWN_HOTEL})


def split_by(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """80/10/10 split of the distinct values of ``key``; every row follows its key.

    The held-out part is the ceiling of 20 % of the keys, the test part the ceiling of half of it. The
    result is a comparison of each row's own hash with two cut values, held in a scalar subquery: rows are
    neither shuffled nor joined, so a key holding a third of them costs nothing. A null key is one key.
    """
    total = F.col("total")
    held_out = _held_out(total)
    test = F.ceil(F.lit(TEST_OF_HELD_OUT) * held_out)
    text_key = F.coalesce(F.col(key).cast("string"), F.lit("\u0000null"))
    ids = df.select(text_key.alias("_key")).distinct()
    cuts = keys_at(ids, "_key", {TRAIN: total - held_out, VALIDATION: total - test}, seed=seed)
    limits = cuts.select(F.struct(TRAIN, VALIDATION)).scalar()
    own = order_key(text_key, seed)
    split = (
        F.when(own <= limits[TRAIN], TRAIN).when(own <= limits[VALIDATION], VALIDATION).otherwise(TEST)
    )
    return df.withColumn("split", split)


def review_split(aspects: DataFrame, seed: int = SEED) -> DataFrame:
    """Split by review: all aspect rows of a review stay together."""
    return split_by(aspects, "review_id", seed)


def hotel_split(aspects: DataFrame, seed: int = SEED) -> DataFrame:
    """Split by hotel: no hotel is in two splits; row shares are whatever the hotels give."""
    return split_by(with_known_hotels(aspects), "hotel_name", seed)


def stratified_split(
    df: DataFrame, key: str, stratum: str, seed: int = SEED, classes: tuple[int, ...] = LABELS
) -> DataFrame:
    """80/20 split with the class shares kept: the cut is taken inside each class.

    One cut value per class of the domain is broadcast and every row is compared with its class's cut, so
    a class with most of the rows is not gathered anywhere. Rows outside the domain get no split.
    """
    known = F.col(stratum).isin(*classes)
    total = F.col("total")
    cuts = keys_at(df.where(known).select(key, stratum), key, {"cut": total - _held_out(total)}, (stratum,), seed)
    split = F.when(order_key(F.col(key), seed) <= F.col("cut"), TRAIN).when(known, VALIDATION)
    return df.join(F.broadcast(cuts), stratum, "left").select(*df.columns, split.alias("split"))


def rows_of_ids(df: DataFrame, ids: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows whose key is among the ids of a stored split, null matching null.

    Rows without a key are let through by one scalar test and not joined, so they never meet in one task.
    """
    wanted = ids.select(key).dropna()
    null_wanted = ids.agg(F.coalesce(F.max(F.col(key).isNull()), F.lit(False)).alias("wanted")).scalar()
    return df.join(wanted, key, "left_semi").select(*df.columns).unionByName(df.where(F.col(key).isNull()).where(null_wanted))


def routed(df: DataFrame, splits: tuple[str, ...] = PREASSIGNED_SPLITS) -> DataFrame:
    """Rows assigned to one of the known splits; all others vanish."""
    return df.where(F.col("split").isin(*splits))


def split_report(df: DataFrame, group: str = "hotel_name", label: str = "sentiment_label") -> DataFrame:
    """Rows, groups, and class counts and percentages of each split."""
    rows = F.count(F.lit(1))
    counts = {f"label_{k}": F.count_if(F.col(label) == k) for k in LABELS}
    return df.groupBy("split").agg(
        rows.alias("n_rows"),
        F.count_distinct(group).alias("n_groups"),
        *[c.alias(name) for name, c in counts.items()],
        *[percent(c, rows).alias(f"{name}_pct") for name, c in counts.items()],
    )
