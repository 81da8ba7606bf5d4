"""CSV and TSV files; schemas are always given, never inferred.

Spark's own reader cannot split a file whose records may span lines. With ``multi_line`` records are cut by ``records``
instead, in parallel, and only their fields are left to Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kuchikomi.domain import ASPECT_ROWS, LABELLED, NULL_TEXT
from kuchikomi.sources.records import records

QUOTE = '"'


def _read(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, null_text: str, sep: str, header: bool) -> DataFrame:
    options = {
        "quote": QUOTE,
        "escape": QUOTE,
        "sep": sep,
        "nullValue": null_text,
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    if not multi_line:
        return spark.read.options(**options).schema(schema).option("header", header).csv(path)
    found = records(spark, path, QUOTE, header)
    written = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in found.columns[1:])
    # Line breaks inside a record are kept as they are.
    parsed = found.withColumn("_record", F.from_csv("_record", written, options | {"multiLine": "true"}))
    return parsed.select(*[(F.col(f.name).cast(f.dataType) if f.name in found.columns[1:] else F.col("_record")[f.name]).alias(f.name) for f in schema])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str = ASPECT_ROWS,
    multi_line: bool = False,
    null_text: str = NULL_TEXT,
) -> DataFrame:
    """A headered CSV; texts keep their blanks, quotes and commas, and line breaks with ``multi_line``.

    ``null_text`` stands for null, as ``sinks.write_csv`` writes it; files of other programs often leave null empty
    and need the empty string here.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _read(spark, path, kind, multi_line, null_text, ",", True)


def read_labelled_tsv(spark: SparkSession, path: str, multi_line: bool = False, null_text: str = NULL_TEXT) -> DataFrame:
    """Labelled sentences: tab-separated, no header, columns id, label, text, annotation, split.

    A label may be written as a whole number or with decimals; anything else becomes null.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in LABELLED.fields])
    rows = _read(spark, path, as_text, multi_line, null_text, "\t", False)
    return rows.withColumn("label", F.col("label").try_cast("double").try_cast("int"))
