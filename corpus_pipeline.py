"""From raw documents to token ids: stages of the training-data operators, each on all that the one before kept.

Edge cases in every stage: null texts count as empty, null ids are ids like any other, rows that repeat are judged each on
its own (of equal texts one stays after the near copies), texts of any length are read whole, columns beyond those of
the documents are dropped, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kuchikomi.llm import bpe, decontamination, jaccard_join, quality, toxicity
from kuchikomi.llm.rows import stored, table

#: Words and pieces a worker's tokenizer remembers a generation: fewer than alone, for workers also hold what stages before left.
MOST_KEPT = 50_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the counterfactual classifier does not call toxic."""
    return toxicity.filtered(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity under the model of trusted text is usual for their language."""
    return quality.filtered(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies."""
    return jaccard_join.deduplicated(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row that is left, with the digests that prove the round trip."""
    return bpe.encoded(docs, columns=("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"), most_kept=MOST_KEPT)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near copies", without_copies),
    ("decontamination", without_benchmark),
    ("token ids", token_ids),
]

#: The classifier, the language model and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
