"""A review table with a key index: a delivery reads the keys it may repeat, not the keys of all history.

The table is a folder with one part a delivery; a folder in it that plain readers pass over holds the index::

    delivery=7                     the reviews a delivery added
    _index/keys/run=7/bucket=3     their keys, sorted by hash
    _index/filters/run=7/bucket=3  Bloom filters of those keys, one bitmap a block
    _index/manifest/delivery=7     number of buckets, of keys, and the runs that hold each bucket's keys

A key's hash names its bucket by linear hashing: the number of buckets follows the number of keys, and when it grows only
the buckets that are split are written again. A bucket kept in too many runs is merged into one. Filters are blocked: a key
sets ``BITS_PER_KEY`` bits of one bitmap, so a test reads one bitmap of a run. Nothing is ever changed in place. A delivery
counts once its manifest is there: one that failed before is written again under the same number, and its remains are
never read. Runs that no manifest names any longer can be removed when no reader is left.

What a delivery costs: its own reviews once, the filters of the buckets it falls into (10 bits a key held there), and the keys
of those buckets a filter calls possible. The driver holds the list of buckets, one entry a million keys.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kuchikomi.operators.collection import BITMAP_BITS, bit_is_set, first_of_key, key_hash
from kuchikomi.session import fresh_path
from kuchikomi.streaming.ingest import KEY, STORED, new_reviews, read_line_stream

KEYS_PER_BUCKET = 1 << 20
KEYS_PER_BLOCK = BITMAP_BITS // 10
BITS_PER_KEY = 4
MOST_RUNS = 8
HASH = "_hash"


@dataclass(frozen=True)
class State:
    """What the latest complete delivery left."""

    delivery: int = 0
    buckets: int = 1
    keys: int = 0
    blocks: int = 1
    runs: dict[int, list[int]] = field(default_factory=dict)


def latest(spark: SparkSession, table: str) -> State:
    """The state of the newest delivery whose manifest is complete."""
    try:
        found = spark.read.schema("state string, delivery bigint").parquet(f"{table}/_index/manifest").orderBy(F.desc("delivery")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return State()
    if found is None:
        return State()
    values = json.loads(found.state)
    return State(**values | {"runs": {int(b): r for b, r in values["runs"].items()}})


def address(value: int, buckets: int) -> int:
    """The bucket of a hash when there are so many: as many low bits as are in use, one less where that bucket is still to come."""
    bits = max(buckets - 1, 1).bit_length()
    low = value & ((1 << bits) - 1)
    return low if low < buckets else low & ((1 << (bits - 1)) - 1)


def bucket_of(value: Column, buckets: int) -> Column:
    """``address`` as an expression."""
    bits = max(buckets - 1, 1).bit_length()
    low = value.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return F.when(low < buckets, low).otherwise(low.bitwiseAND(F.lit((1 << (bits - 1)) - 1).cast("bigint"))).cast("int")


def block_of(value: Column, blocks: int) -> Column:
    """The bitmap of a key, from bits the bucket does not use."""
    return F.pmod(F.shiftrightunsigned(value, 40), F.lit(blocks)).cast("int")


def bits_of(value: Column) -> list[Column]:
    """The bits a key sets in its bitmap."""
    other = F.xxhash64(value, F.lit("bits"))
    return [F.shiftrightunsigned(other, 15 * i).bitwiseAND(F.lit(BITMAP_BITS - 1).cast("bigint")).cast("int") for i in range(BITS_PER_KEY)]


def _paths(table: str, tree: str, places: list[tuple[int, int]]) -> list[str]:
    return [f"{table}/_index/{tree}/run={run}/bucket={bucket}" for run, bucket in sorted(places)]


def _read(spark: SparkSession, table: str, tree: str, places: list[tuple[int, int]], schema: str) -> DataFrame:
    whole = f"{schema}, run int, bucket int"
    if not places:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{table}/_index/{tree}").parquet(*_paths(table, tree, places))


KEY_SCHEMA = f"{HASH} bigint, {', '.join(f'{c} string' for c in KEY)}"


def possible_places(spark: SparkSession, table: str, state: State, keys: DataFrame) -> list[tuple[int, int]]:
    """Runs and buckets whose filters call any of the keys possible; nothing else can hold one of them."""
    placed = keys.select(HASH, bucket_of(F.col(HASH), state.buckets).alias("bucket"), block_of(F.col(HASH), state.blocks).alias("block"))
    touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # one value a bucket at most
    filters = _read(spark, table, "filters", [(run, b) for b in touched for run in state.runs.get(b, [])], "block int, bits binary")
    possible = placed.join(filters, ["bucket", "block"])
    for bit in bits_of(F.col(HASH)):
        possible = possible.where(bit_is_set(F.col("bits"), bit))
    return [(r.run, r.bucket) for r in possible.select("run", "bucket").distinct().collect()]


def held_keys(spark: SparkSession, table: str, state: State, keys: DataFrame) -> DataFrame:
    """The keys of the places that may hold one of ``keys``."""
    return _read(spark, table, "keys", possible_places(spark, table, state, keys), KEY_SCHEMA).select(HASH, *KEY)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a[HASH] == b[HASH]) & a[KEY[0]].eqNullSafe(b[KEY[0]]) & a[KEY[1]].eqNullSafe(b[KEY[1]])


def _write_index(spark: SparkSession, table: str, state: State, delivery: int, rows: int, keys_per_bucket: int) -> State:
    """Keys and filters of a delivery's reviews, and of the buckets that are split or merged with it."""
    total = state.keys + rows
    buckets = max(state.buckets, -(-total // keys_per_bucket))
    split = {address(b, state.buckets) for b in range(state.buckets, buckets)}
    moved = {b for b, runs in state.runs.items() if b in split or len(runs) >= MOST_RUNS}
    old = _read(spark, table, "keys", [(run, b) for b in moved for run in state.runs[b]], KEY_SCHEMA).select(HASH, *KEY)
    new = spark.read.parquet(f"{table}/delivery={delivery}").select(key_hash(KEY).alias(HASH), *KEY)
    run = f"{table}/_index/keys/run={delivery}"
    placed = new.unionByName(old).withColumn("bucket", bucket_of(F.col(HASH), buckets))
    placed.repartition("bucket").sortWithinPartitions("bucket", HASH).write.mode("overwrite").partitionBy("bucket").parquet(run)
    written = spark.read.schema(f"{KEY_SCHEMA}, bucket int").parquet(run)
    set_bits = written.select("bucket", block_of(F.col(HASH), state.blocks).alias("block"), F.explode(F.array(*bits_of(F.col(HASH)))).alias("bit"))
    filters = set_bits.groupBy("bucket", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/_index/filters/run={delivery}")
    here = {r.bucket for r in written.select("bucket").distinct().collect()}
    runs = {b: [delivery] if b in moved or b in range(state.buckets, buckets) else [*state.runs.get(b, []), delivery] for b in here}
    kept = {b: r for b, r in state.runs.items() if b not in moved and b not in here}
    return State(delivery, buckets, total, state.blocks, kept | runs)


def append_indexed(batch: DataFrame, table: str, keys_per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Append the reviews of a batch whose (hotel, id) the table does not hold; return how many were added.

    Of several copies the one with the earliest post time and then the smallest hash wins, and an id already stored stays
    as it is. A batch run again after a failure adds nothing, or what the failure left out.
    """
    spark = batch.sparkSession
    state = latest(spark, table)
    if not state.delivery:
        state = State(blocks=-(-keys_per_bucket // KEYS_PER_BLOCK))
    if "hotel_id" not in batch.columns:
        batch = batch.withColumn("hotel_id", F.lit(None).cast("string"))
    arrived = fresh_path(spark, "arrived")
    batch.write.parquet(arrived)  # decoded once; what follows reads it in narrow columns
    stored = spark.read.schema(batch.schema).parquet(arrived)
    order = [c for c in ("postDateTime",) if c in batch.columns]
    unique = first_of_key(stored, KEY, order).withColumn(HASH, key_hash(KEY))
    held = held_keys(spark, table, state, stored.select(key_hash(KEY).alias(HASH)).distinct())
    delivery, new = state.delivery + 1, unique.join(held, _same(unique, held), "left_anti").drop(HASH)
    target = f"{table}/delivery={delivery}"
    new.write.mode("overwrite").parquet(target)
    rows = spark.read.schema(batch.schema).parquet(target).count()
    if rows:
        state = _write_index(spark, table, state, delivery, rows, keys_per_bucket)
        text = json.dumps({"delivery": delivery, "buckets": state.buckets, "keys": state.keys, "blocks": state.blocks, "runs": state.runs})
        spark.createDataFrame([(text,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{table}/_index/manifest/delivery={delivery}")
    return rows


def collected_indexed(spark: SparkSession, table: str, schema: T.StructType = STORED) -> DataFrame:
    """The reviews of all complete deliveries; none, with the given schema, before the first."""
    last = latest(spark, table).delivery
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(table).where(F.col("delivery") <= last).drop("delivery")


def ingest_indexed(
    spark: SparkSession, source: str, table: str, checkpoint: str, max_files: int | None = None, keys_per_bucket: int = KEYS_PER_BUCKET
) -> StreamingQuery:
    """Process the files that have arrived since the last run, then stop."""
    return (
        new_reviews(read_line_stream(spark, source, max_files))
        .writeStream.foreachBatch(lambda batch, _: append_indexed(batch, table, keys_per_bucket))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
