"""Incremental ingest: review lines arrive in a folder, ids already stored are ignored."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kuchikomi.domain import RAW_REVIEW
from kuchikomi.operators.collection import first_per_key, identified, not_yet_collected
from kuchikomi.sources.assets import open_asset
from kuchikomi.sources.review_lines import accepted, parse_review_lines

# An id is unique within its hotel. Stored reviews lie in folders by a hash of both.
KEY = ["hotel_id", "id"]
BUCKETS = 64
BUCKET = "bucket"


def read_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files of review lines below ``path`` as a stream of ``(file_name, line)``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("line"))


def new_reviews(lines: DataFrame) -> DataFrame:
    """Readable reviews with an id."""
    return identified(accepted(parse_review_lines(lines)))


def unique_stream(reviews: DataFrame, time_column: str | None = None, lateness: str | None = None) -> DataFrame:
    """A stream with each id of a hotel once, by state store.

    The state grows with the ids unless a time column and a lateness bound are given. Which copy of an id
    survives is not defined; ``append_new`` settles that too.
    """
    if time_column and lateness:
        return reviews.withWatermark(time_column, lateness).dropDuplicatesWithinWatermark(KEY)
    return reviews.dropDuplicates(KEY)


def append_new(batch: DataFrame, table: str, buckets: int = BUCKETS) -> int:
    """Append to ``table`` the reviews of a batch whose (hotel, id) it does not hold; return how many were added.

    Of several copies the one with the earliest post time and then the smallest hash wins. The table itself is the
    memory: a batch run again after a failure finds its ids stored and adds nothing. Only the keys in the folders
    the batch touches are read, once, and joined as AQE sees fit. A table keeps its number of buckets.
    """
    spark = batch.sparkSession
    if "hotel_id" not in batch.columns:
        batch = batch.withColumn("hotel_id", F.lit(None).cast("string"))
    order = [c for c in ("postDateTime",) if c in batch.columns]
    placed = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
    unique = first_per_key(placed, KEY, order).persist(StorageLevel.MEMORY_AND_DISK)
    new, stored = unique, open_asset(spark, table)
    try:
        if stored is not None:
            touched = [r[BUCKET] for r in unique.select(BUCKET).distinct().collect()]  # at most as many values as buckets
            new = not_yet_collected(unique, stored.where(F.col(BUCKET).isin(touched)), KEY).persist(StorageLevel.MEMORY_AND_DISK)
        rows = new.count()
        if rows:
            # One file per folder and batch: the rows of a folder are brought together before they are written.
            new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(table)
        return rows
    finally:
        new.unpersist()
        unique.unpersist()


STORED = T.StructType([T.StructField("hotel_id", T.StringType()), *RAW_REVIEW.fields])


def collected(spark: SparkSession, table: str, schema: T.StructType = STORED) -> DataFrame:
    """The reviews stored by ``append_new``; none, with the given schema, before the first one is stored."""
    stored = open_asset(spark, table)
    return spark.createDataFrame([], schema) if stored is None else stored.drop(BUCKET)


def ingest(
    spark: SparkSession, source: str, table: str, checkpoint: str, max_files: int | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Process the files that have arrived since the last run, then stop."""
    return (
        new_reviews(read_line_stream(spark, source, max_files))
        .writeStream.foreachBatch(lambda batch, _: append_new(batch, table, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
