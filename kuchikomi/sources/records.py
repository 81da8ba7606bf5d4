"""Records of delimited files whose quoted texts may hold line breaks, cut by as many tasks as the files have splits.

Whether a line break ends a record depends on the quotes before it: an even number is outside quotes. A first pass counts
the quotes of every split of a file; a prefix over a file's splits then tells each of them whether it begins inside quotes.
In the second pass a split cuts its own lines into records. Only what crosses a border is moved: at most the end of a record
at the head of a split and the start of one at its tail, which are put together by the split where the record began.

A file that ends inside quotes ends with a record of all that is left, as other readers have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPLIT = ["_file", "_block"]
WHOLE, HEAD, TAIL = "whole", "head", "tail"
_CUT = "_file long, _block long, _part string, _first boolean, _record string"


def _place() -> Column:
    """In one split what ends an earlier record comes before what starts a new one."""
    return F.when(F.col("_part") == TAIL, 1).otherwise(0)


def file_lines(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``_file, _block, _line, _quotes`` and the folders' columns: a file by a hash of its path, a split by where it starts.

    Lines of a split come in their order.
    """
    line, stored = F.col("value"), spark.read.option("lineSep", "\n").text(path)
    return stored.select(
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        line.alias("_line"),
        (F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))).alias("_quotes"),
        *[c for c in stored.columns if c != "value"],
    )


def quoted_splits(lines: DataFrame) -> DataFrame:
    """``_file, _block`` of the splits that begin inside quotes. The window runs over splits, not lines."""
    parity = lines.groupBy(*SPLIT).agg((F.sum("_quotes") % 2).alias("_odd"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return parity.withColumn("_before", F.sum("_odd").over(before)).where("_before % 2 = 1").select(*SPLIT)


class Cutter:
    """The records of one split, fed by batches of its lines; ``held`` is what is not closed yet."""

    def __init__(self, split: tuple[int, int], inside: bool):
        self.split, self.inside, self.own = split, inside, not inside
        self.held: list[str] = []
        self.first = split[1] == 0

    def closed(self, part: str) -> tuple[str, bool, str]:
        out = (part, self.first, "\n".join(self.held))
        self.held, self.first, self.own = [], False, True
        return out

    def feed(self, lines: list[str], odd: np.ndarray) -> Iterator[tuple[str, bool, str]]:
        """``odd`` tells the lines after which the text is on the other side of quotes; all between two of them stay together."""
        at = 0
        for turn in [*np.flatnonzero(odd).tolist(), len(lines)]:
            if self.inside:
                self.held += lines[at : turn + 1]
                if turn < len(lines):
                    yield self.closed(WHOLE if self.own else HEAD)
            else:
                for line in lines[at:turn]:
                    self.held.append(line)
                    yield self.closed(WHOLE)
                self.held += lines[turn : turn + 1]
            self.inside ^= turn < len(lines)
            at = turn + 1

    def end(self) -> Iterator[tuple[str, bool, str]]:
        if self.held:
            yield self.closed(TAIL if self.own else HEAD)


def records(spark: SparkSession, path: str, quote: str = '"', header: bool = False) -> DataFrame:
    """Every record of the files below ``path`` as text in ``_record``, beside the folders' columns.

    Empty records, and with ``header`` the first of each file, are left out.
    """
    lines = file_lines(spark, path, quote)
    # Eight bytes for a split of some 128 MB that begins inside quotes.
    inside = [r._split for r in quoted_splits(lines).select(F.xxhash64(*SPLIT).alias("_split")).collect()]
    shared = spark.sparkContext.broadcast(np.sort(np.array(inside, dtype=np.int64)))
    folders = lines.columns[4:]
    schema = T.StructType([*T.StructType.fromDDL(_CUT).fields, *(lines.schema[c] for c in folders)])
    arrow = to_arrow_schema(schema)

    def made(split: tuple[int, int], constants: list, rows: list[tuple[str, bool, str]]) -> pa.RecordBatch:
        columns = [[split[0]] * len(rows), [split[1]] * len(rows), *zip(*rows), *([c] * len(rows) for c in constants)]
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cutter, constants = shared.value, None, []
        for batch in batches:
            file, block, split = (batch.column(c).to_numpy() for c in ("_file", "_block", "_split"))
            text, odd = batch.column("_line").to_pylist(), batch.column("_quotes").to_numpy() % 2 == 1
            starts = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])])) if len(file) else []
            for a, b in zip(starts, [*starts[1:], len(file)]):
                here = (int(file[a]), int(block[a]))
                if cutter is None or cutter.split != here:
                    if cutter is not None and (rest := list(cutter.end())):
                        yield made(cutter.split, constants, rest)
                    cutter = Cutter(here, bool(np.isin(split[a], known)))
                    constants = [batch.column(c)[a].as_py() for c in folders]
                if rows := list(cutter.feed(text[a:b], odd[a:b])):
                    yield made(here, constants, rows)
        if cutter is not None and (rest := list(cutter.end())):
            yield made(cutter.split, constants, rest)

    cut = lines.withColumn("_split", F.xxhash64(*SPLIT)).mapInArrow(run, schema)
    whole = cut.where(F.col("_part") == WHOLE).select("_first", "_record", *folders)
    order = Window.partitionBy("_file").orderBy("_block", _place())
    parts = cut.where(F.col("_part") != WHOLE).withColumn("_began", F.last(F.when(F.col("_part") == TAIL, F.col("_block")), ignorenulls=True).over(order))
    in_order = F.array_sort(F.collect_list(F.struct("_block", _place().alias("place"), "_record")))
    joined = parts.groupBy("_file", "_began", *folders).agg(F.max("_first").alias("_first"), F.array_join(F.transform(in_order, lambda p: p["_record"]), "\n").alias("_record"))
    found = whole.unionByName(joined.select("_first", "_record", *folders))
    ended = F.regexp_replace("_record", r"\r\z", "")
    wanted = ended != ""
    return found.where(wanted & ~F.col("_first") if header else wanted).select(ended.alias("_record"), *folders)
