"""What the operators share: input columns, whole-text passes, folders, shuffle width."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kuchikomi.session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *also: Column) -> DataFrame:
    """Only ``doc_id`` and ``text``, null texts as empty ones, and what else is asked for; other columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *also)


def id_remainder(n: int) -> Column:
    """crc32 of the id's digits, modulo ``n``; a null id counts as an empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


ROWS_AT_ONCE = 1_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python ``ROWS_AT_ONCE`` at most, so neither side ever holds a batch of ten thousand; never more than the session says."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= ROWS_AT_ONCE:
        spark.conf.set(ARROW_ROWS, str(ROWS_AT_ONCE))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that what a task makes of one of them stays small whatever the session's batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def frames(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """Map a partition's batches as pandas frames; unlike ``mapInPandas``, integers stay integers beside nulls."""
    small_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get
        for out in function(b.to_pandas(types_mapper=whole) for b in slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, kind)


def per_row(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """One batch in, one out; ``function`` sees whole rows and never more than a batch."""
    return frames(df, lambda batches: map(function, batches), schema)


def keep(docs: DataFrame, wanted: Callable[..., list[bool]], also: tuple[str, ...] = ()) -> DataFrame:
    """The rows that ``wanted(texts, *also)`` picks, all columns untouched; a null text is judged as an empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in also]
            yield batch.filter(pa.array([bool(x) for x in wanted([t or "" for t in batch.column("text").to_pylist()], *columns)]))

    return docs.mapInArrow(run, docs.schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers of which hash partitioning puts one into each of ``n`` partitions."""
    candidates = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("key"))
    found = candidates.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("part")).agg(F.min("key").alias("key"))
    keys = {r.part: r.key for r in found.collect()}
    return [keys.get(p, p) for p in range(n)]


def dealt_by(rows: DataFrame, number: str, n: int) -> DataFrame:
    """One partition for each value 0 to ``n`` - 1 of the column ``number``: no two share a task."""
    keys = F.lit(even_keys(rows.sparkSession, n))
    return rows.withColumn("_key", F.element_at(keys, F.col(number) + 1)).repartition(n, "_key").drop("_key")


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, across batch borders; the input must be sorted by the keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        changes = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        starts = [0, *(np.nonzero(changes)[0] + 1).tolist()]
        if held and (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
            starts = starts[1:]
            if not starts:
                held.append(batch)
                continue
            held.append(batch.iloc[: starts[0]])
        if held:
            yield pd.concat(held, ignore_index=True)
        for a, b in zip(starts, starts[1:]):
            yield batch.iloc[a:b]
        held = [batch.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True)
