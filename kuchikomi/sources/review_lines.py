"""Raw reviews as JSON lines, one file per hotel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import CORRUPT, RESEARCH
from kuchikomi.functions.text import filled, strip
from kuchikomi.sources import review_json

HOTEL_FILE = r"hotel_([^/]+)_reviews\.jsonl"


def hotel_of_file(file_name: Column) -> Column:
    """The hotel id in a path with a file or folder ``hotel_<id>_reviews.jsonl``, null for any other path."""
    return F.nullif(F.regexp_extract(file_name, HOTEL_FILE, 1), F.lit(""))


def read_review_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines below ``path`` (a folder, glob or file) with the path of the file each came from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("line"))


def files_read(spark: SparkSession, path: str) -> DataFrame:
    """Number of files per hotel below ``path``, those without a usable line included; contents are not read.

    A folder named as a file is one file, however many tasks wrote its parts.
    """
    whole = F.regexp_extract("path", f"^.*{HOTEL_FILE}", 0)
    names = spark.read.format("binaryFile").load(path).select(hotel_of_file(F.col("path")).alias("hotel_id"), F.when(whole == "", F.col("path")).otherwise(whole).alias("file"))
    return names.distinct().groupBy("hotel_id").agg(F.count(F.lit(1)).alias("files"))


def parse_review_lines(lines: DataFrame) -> DataFrame:
    """Decode ``(file_name, line)``; a line that is not one JSON object keeps its text in the corrupt column, and nothing else.

    A field of an unexpected type is converted or becomes null; it does not cost the review. Blank lines are
    dropped before anything is counted. Each line is read once: a filter on the result does not pass the ``explode`` to read it again.
    """
    review, line = F.col("_review"), F.col("line")
    return (
        lines.where(strip(line) != "")
        .select(hotel_of_file(F.col("file_name")).alias("hotel_id"), "line", F.explode(F.array(review_json.marked(line))).alias("_elements"))
        .select("hotel_id", "line", review_json.alone(line, F.col("_elements")).alias("_review"))
        .select("hotel_id", *review_json.typed(review), F.when(review.isNull(), line).alias(CORRUPT))
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """Lines that decoded."""
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines that did not decode, as text."""
    return parsed.where(F.col(CORRUPT).isNotNull()).select("hotel_id", F.col(CORRUPT).alias("line"))


def line_counts() -> dict[str, Column]:
    """Input, written and skipped lines."""
    return {
        "input_reviews": F.count(F.lit(1)),
        "written_reviews": F.count_if(F.col(CORRUPT).isNull()),
        "skipped_reviews": F.count_if(F.col(CORRUPT).isNotNull()),
    }


def ingest_audit(parsed: DataFrame) -> DataFrame:
    """Input, written and skipped lines per hotel, in one pass over the parsed lines."""
    return parsed.groupBy("hotel_id").agg(*[c.alias(name) for name, c in line_counts().items()])


def collected_ids(reviews: DataFrame, id_column: str = "id") -> DataFrame:
    """Distinct, non-empty ids already stored: the state a resumed collection starts from."""
    return reviews.select(F.col(id_column).cast("string").alias("review_id")).where(filled(F.col("review_id"))).distinct()


def read_research(spark: SparkSession, path: str) -> DataFrame:
    """The research corpus written as JSON lines."""
    return spark.read.schema(RESEARCH).json(path)
