"""Class balancing: inverse-frequency weights, exact draws with replacement, capped subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kuchikomi.domain import BATCH_ROWS, CHECKED_BATCHES, LABELS, SEED, SUBSET_CAPS
from kuchikomi.functions.hashing import digest, hex_number, unit_interval
from kuchikomi.operators.frequency import frequencies
from kuchikomi.operators.ranks import seeded, with_rank
from kuchikomi.session import shuffle_partitions

DRAWS_PER_CHUNK = 65_536


def class_sizes(df: DataFrame, label: str, classes: tuple[int, ...] = LABELS) -> DataFrame:
    """Rows of each class of the domain: never more rows than classes, hence safe to broadcast."""
    return frequencies(df.where(F.col(label).isin(*classes)), label)


def inverse_weights(df: DataFrame, label: str, classes: tuple[int, ...] = LABELS) -> DataFrame:
    """Add ``weight``, one over the size of the row's class; null for a label outside the domain."""
    sizes = class_sizes(df, label, classes).select(label, (F.lit(1.0) / F.col("n")).alias("weight"))
    return df.join(F.broadcast(sizes), label, "left")


def drawn_ids(spark: SparkSession, count: Column) -> DataFrame:
    """``draw_id`` from 0 to ``count`` - 1, laid out in chunks spread over all tasks, each chunk expanded where it lies."""
    last = count - 1
    chunks = spark.range(1).where(last >= 0).select(
        F.explode(F.sequence(F.col("id"), last, F.lit(DRAWS_PER_CHUNK).cast("bigint"))).alias("start")
    )
    return chunks.repartition(shuffle_partitions(spark), "start").select(
        F.explode(F.sequence("start", F.least(F.col("start") + (DRAWS_PER_CHUNK - 1), last))).alias("draw_id")
    )


def class_draws(
    df: DataFrame, label: str, seed: int = SEED, draws: int | None = None, classes: tuple[int, ...] = LABELS
) -> DataFrame:
    """As many draws as rows, or ``draws``, which may be more: draw id, the class drawn, and the rank drawn in the class.

    With weights one over class size every class is drawn with equal probability, and every row of a
    class likewise. Both choices come from the md5 of the seed and the draw id.
    """
    spark = df.sparkSession
    sizes = class_sizes(df, label, classes)
    known = sizes.agg(
        F.struct(
            F.array_sort(F.collect_list(F.struct(F.col(label), F.col("n")))).alias("classes"), F.sum("n").alias("total")
        )
    ).scalar()
    total = known["total"]
    count = total if draws is None else F.when(total > 0, F.lit(draws).cast("bigint"))
    hashed = drawn_ids(spark, count).withColumn("_hash", digest(F.lit(seed), F.col("draw_id"))).withColumn("_classes", known["classes"])
    index = F.floor(unit_interval(F.col("_hash"), 1) * F.size("_classes")).cast("int")
    chosen = hashed.withColumn("_class", F.get("_classes", index))
    place = F.floor(unit_interval(F.col("_hash"), 14) * F.col("_class.n")) + 1
    # Never null, and said so: otherwise a join would hash every draw once more to test it.
    known_class = F.coalesce(F.col(f"_class.{label}"), F.lit(classes[0]))
    return chosen.select("draw_id", known_class.alias(label), F.coalesce(place, F.lit(0)).cast("bigint").alias("rank"))


def balanced_sample(
    df: DataFrame,
    key: str,
    label: str,
    seed: int = SEED,
    draws: int | None = None,
    classes: tuple[int, ...] = LABELS,
) -> DataFrame:
    """Class-balanced sample with replacement: one row per draw, with its draw id.

    An equi-join of the draws with the ranked rows on (class, rank), a key without heavy values. Only rows
    of the class domain can be drawn. Both sides are as large as the table, but the draws come out of an
    expanded range the optimizer takes for a few bytes; the hint keeps it from broadcasting them.
    """
    ranked = with_rank(df.where(F.col(label).isin(*classes)), key, (label,), seed)
    drawn = class_draws(df, label, seed, draws, classes)
    return drawn.hint("merge").join(ranked, [label, "rank"]).select("draw_id", *df.columns)


# Weights become whole numbers of units, so that sums are exact in any order: the largest weight has this many.
WEIGHT_UNITS = 2**32
DRAW_BITS = 52
WEIGHT_BUCKETS = 4_096


def weight_units(weight: Column, largest: Column) -> Column:
    """A weight in whole units, at least one if it is positive; null and negative weights, and NaN, have none."""
    usable = (weight > 0) & ~F.isnan(weight)
    units = F.greatest(F.floor(weight / largest * F.lit(float(WEIGHT_UNITS))), F.lit(1)).cast("bigint")
    return F.when(usable, units).otherwise(F.lit(0).cast("bigint"))


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int | None = None, seed: int = SEED) -> DataFrame:
    """``draw_id, key, heavy``: as many draws with replacement as rows, or ``draws``; a row's chance is its share of all weights.

    All rows lie on a line, each as long as its weight: first the heavy ones, each at least 1/4096 of the line and so at most
    4,096, then all others in 4,096 buckets of their md5. A draw is a point on it, from the md5 of the seed and its id. The
    at most 8,192 segments of the line are broadcast; where a draw hits a heavy row it is done. In a bucket rows and
    points are sorted together, and a point takes the last row that starts before it. A bucket's share of rows and of
    points is a few 1/4096 whatever the weights are, because no row in it is heavy. ``key`` identifies a row.
    """
    spark = df.sparkSession
    largest = df.agg(F.max(F.when(~F.isnan(weight), F.col(weight)))).scalar()
    units = df.select(F.col(key).alias("_row"), weight_units(F.col(weight), largest).cast("decimal(20,0)").alias("_units"))
    units = units.where("_units > 0").withColumn("_hash", seeded(F.col("_row"), seed))
    whole = units.agg(F.sum("_units").alias("total"), F.count(F.lit(1)).alias("rows"))
    bucket = F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")
    heavy = F.col("_units") * WEIGHT_BUCKETS >= whole.select("total").scalar()
    placed = units.select("*", F.when(heavy, -1).otherwise(bucket).alias("_bucket"))

    # The line's segments in order: heavy rows, then buckets.
    rows = placed.where("_bucket < 0").select("_bucket", "_hash", "_row", "_units")
    buckets = placed.where("_bucket >= 0").groupBy("_bucket").agg(F.sum("_units").alias("_units"))
    segments = rows.unionByName(buckets, allowMissingColumns=True)
    before = Window.orderBy("_bucket", "_hash", "_row")  # over at most 8,192 rows
    line = segments.withColumn("_end", F.sum("_units").over(before)).withColumn("_start", F.col("_end") - F.col("_units"))
    # Points find their segment by the cell of a grid over the line; a segment lies in the cells it covers, 12,288 rows in all.
    total, cells = whole.select("total").scalar(), WEIGHT_BUCKETS
    cell = lambda point: F.floor(point * cells / total).cast("int")
    grid = line.select("_bucket", "_row", "_start", "_end", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1))).alias("_cell"))

    count = whole.select("rows").scalar() if draws is None else F.when(whole.select("rows").scalar() > 0, F.lit(draws).cast("bigint"))
    hashed = drawn_ids(spark, count).withColumn("_draw", digest(F.lit(seed), F.col("draw_id")))
    share = hex_number(F.col("_draw"), 1, DRAW_BITS // 4).cast("decimal(16,0)")
    product, parts = share * total.cast("decimal(22,0)"), F.lit(2**DRAW_BITS).cast("decimal(16,0)")
    points = hashed.select("draw_id", ((product - product % parts) / parts).cast("decimal(22,0)").alias("_point"))  # exact
    hit = points.withColumn("_cell", cell(F.col("_point"))).join(F.broadcast(grid), "_cell").where("_point >= _start and _point < _end")
    direct = hit.where("_bucket < 0").select("draw_id", F.col("_row").alias(key), F.lit(True).alias("heavy"))

    # In a bucket: where each row starts, and where each point lies.
    inside = Window.partitionBy("_bucket").orderBy("_hash", "_row").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.where("_bucket >= 0").select("_bucket", F.coalesce(F.sum("_units").over(inside), F.lit(0)).cast("decimal(38,0)").alias("_at"), "_row", F.lit(None).cast("bigint").alias("draw_id"))
    asked = hit.where("_bucket >= 0").select("_bucket", (F.col("_point") - F.col("_start")).cast("decimal(38,0)").alias("_at"), F.lit(None).cast(df.schema[key].dataType).alias("_row"), "draw_id")
    order = Window.partitionBy("_bucket").orderBy("_at", F.col("draw_id").isNotNull())
    met = starts.unionByName(asked).withColumn("_found", F.last("_row", ignorenulls=True).over(order))
    light = met.where("draw_id is not null").select("draw_id", F.col("_found").alias(key), F.lit(False).alias("heavy"))
    return direct.unionByName(light)


def weighted_sample(df: DataFrame, key: str, weight: str, draws: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows drawn by ``weighted_draws``, one for each draw, with its id.

    A heavy row may be drawn by most draws: its draws are dealt to 64 copies of it, of at most 4,096 rows in all.
    """
    drawn = weighted_draws(df, key, weight, draws, seed)
    copies = 64
    salted = drawn.withColumn("_copy", F.when(F.col("heavy"), F.pmod(F.col("draw_id"), F.lit(copies)).cast("int")).otherwise(0))
    chosen = drawn.where("heavy").select(key).distinct().withColumn("_many", F.lit(True))
    marked = df.join(F.broadcast(chosen), key, "left")
    spread = marked.withColumn("_copy", F.explode(F.when(F.col("_many"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    return salted.hint("merge").join(spread, [key, "_copy"]).select("draw_id", *df.columns)


def batch_composition(
    df: DataFrame, label: str, seed: int = SEED, batches: int = CHECKED_BATCHES, batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Class counts of the first batches a balanced sample as long as the table delivers. Needs the classes drawn, not the rows."""
    rows = class_sizes(df, label).agg(F.sum("n")).scalar()
    drawn = class_draws(df, label, seed, batches * batch_rows).where(F.col("draw_id") < rows)
    batch = F.floor(F.col("draw_id") / batch_rows).cast("bigint").alias("batch")
    return drawn.groupBy(batch, label).agg(F.count(F.lit(1)).alias("n"))


def capped_subset(df: DataFrame, label: str, order_by: list[str], caps: dict[int, int] | None = None) -> DataFrame:
    """The first rows of each class, up to the class's cap.

    The constant bound beside the cap per class lets each map task drop all but its first rows, so a class
    with most of the rows never meets in one task.
    """
    caps = caps or SUBSET_CAPS
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order_by))
    cap = F.lit(None).cast("int")
    for value, rows in caps.items():
        cap = F.when(F.col(label) == value, F.lit(rows)).otherwise(cap)
    return (
        df.where(F.col(label).isin(*caps))
        .withColumn("_place", place)
        .where(F.col("_place") <= max(caps.values()))
        .where(F.col("_place") <= cap)
        .drop("_place")
    )
