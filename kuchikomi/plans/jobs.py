"""Whole jobs, from stored input to stored output and reports.

Each job takes the session and paths and returns its reports as named DataFrames. Tables between jobs are
Parquet; ``sinks`` writes the exchange formats where another program needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECT_ROWS, ASPECTS, LABELS, SEQUENCE_LENGTH, SUBWORD_VOCABULARY
from kuchikomi.functions.scores import recode_polarity
from kuchikomi.operators import (
    audit,
    classifier,
    collection,
    corpus,
    duplicates,
    evaluation,
    features,
    frequency,
    sampling,
    splits,
    trends,
    vocabulary,
)
from kuchikomi.session import fresh_path, prepare
from kuchikomi.sources import assets, delimited, pages, review_lines, sinks
from kuchikomi.streaming.indexed import append_indexed, collected_indexed, ingest_indexed

Reports = dict[str, DataFrame]


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; a path ending in .csv or .jsonl is read in that format."""
    prepare(spark)
    if path.endswith(".csv"):
        return delimited.read_csv(spark, path, ASPECT_ROWS)
    if path.endswith(".jsonl"):
        return review_lines.read_research(spark, path)
    return spark.read.parquet(path)


def collect_pages(spark: SparkSession, pages_path: str, output: str) -> Reports:
    """Extract the reviews of stored pages ``(hotel_id, page_id, html)`` and add the new ones to a table.

    The copy on the earliest page wins. The report compares what is held with what the pages say exists.
    """
    decoded = fresh_path(spark, "decoded-pages")
    sinks.write_parquet(pages.extract_pages(_table(spark, pages_path)), decoded)  # markup is decoded once for all reports
    extracted = spark.read.parquet(decoded)
    found = collection.identified(pages.page_reviews(extracted))
    first = collection.first_of_key(found, ["hotel_id", "id"], ["page_id", "position"]).drop("page_id", "position", "reported_total")
    added = append_indexed(first, output)
    held = collected_indexed(spark, output, first.schema).select("hotel_id", F.col("id").alias("review_id"))
    return {
        "run": extracted.agg(F.count(F.lit(1)).alias("pages")).withColumn("reviews_added", F.lit(added).cast("bigint")),
        "remaining": collection.reconciliation(held, extracted),
        "unreadable": pages.unreadable_pages(extracted),
        "page_ends": pages.page_ends(extracted),
    }


def collect_lines(spark: SparkSession, source: str, output: str, checkpoint: str) -> Reports:
    """Add the review lines that arrived in ``source`` since the last run, each id once; nothing may have arrived yet."""
    ingest_indexed(prepare(spark), source, output, checkpoint).awaitTermination()
    held = collected_indexed(spark, output)
    return {"held": held.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("reviews"))}


def build_research(spark: SparkSession, lines: str, output: str, source: str) -> Reports:
    """Raw review lines to the research corpus; reports count files and lines read, written and skipped per hotel.

    Totals are counted while the decoded lines are written.
    """
    decoded = fresh_path(spark, "decoded-lines")
    counted = sinks.write_counted(
        review_lines.parse_review_lines(review_lines.read_review_lines(prepare(spark), lines)), decoded, **review_lines.line_counts()
    )
    parsed = spark.read.parquet(decoded)  # lines are decoded once for the corpus and all reports
    sinks.write_parquet(corpus.research_corpus(review_lines.accepted(parsed), source), output)
    totals = [int(counted.get(name) or 0) for name in review_lines.line_counts()]
    return {
        "totals": spark.createDataFrame([tuple(totals)], ", ".join(f"{name} bigint" for name in review_lines.line_counts())),
        "ingest": review_lines.ingest_audit(parsed),
        "files": review_lines.files_read(spark, lines),
        "rejected": review_lines.rejected(parsed),
    }


def build_aspects(spark: SparkSession, research: str, output: str) -> Reports:
    """Research corpus to the labelled aspect corpus, stored in reading order.

    Records, aspects and labels are counted while the rows are written; only the distinct reviews need a pass of their own.
    """
    rows = corpus.aspect_corpus(_table(spark, research), ordered=True)
    domains = {"aspect": ASPECTS, "sentiment_label": LABELS}
    metrics = {k: m for column, values in domains.items() for k, m in frequency.counts_of_domain(column, values).items()}
    found = sinks.write_counted(rows, output, records=F.count(F.lit(1)), **metrics)
    counted = {column: frequency.domain_frequencies(spark, column, values, found) for column, values in domains.items()}
    reviews = spark.read.parquet(output).agg(F.count_distinct("review_id").alias("reviews"))
    return {
        "summary": reviews.withColumn("records", F.lit(found.get("records", 0)).cast("bigint")),
        "aspects": frequency.by_count(counted["aspect"]),
        "labels": frequency.by_value(counted["sentiment_label"]),
    }


def profile_research(spark: SparkSession, research: str) -> Reports:
    """Duplicates, comment lengths, time coverage and score distributions of the research corpus."""
    reviews = _table(spark, research)
    return {
        "shape": assets.overview(reviews),
        "repeated": audit.repeated_values(reviews, ["review_id", "comment"]),
        "missing": audit.null_counts(reviews.select("comment", "post_datetime", "check_in_date")),
        "lengths": audit.length_description(reviews, "comment"),
        "coverage": audit.temporal_coverage(reviews),
        "scores": frequency.score_distribution(corpus.flatten_scores(reviews)).orderBy("aspect", F.asc_nulls_last("score")),
    }


def check_quality(spark: SparkSession, aspects: str) -> Reports:
    """Dates, hotels, aspect domain, nulls, missing texts and repeated comments of the aspect corpus.

    All whole-table figures come from one pass and all per-aspect figures from another; both results are a few rows.
    """
    rows = _table(spark, aspects)
    whole = rows.agg(*audit.date_facts(), *audit.text_facts()).persist()
    by_aspect = audit.aspect_nulls(rows).persist()
    texts = [c for c in whole.columns if c.startswith(("null_or_empty", "short_with_empty"))]
    counts = by_aspect.select("aspect", "n")
    return {
        "dates": whole.drop(*texts),
        "domain": audit.domain_standing(counts),
        "shares": frequency.shares_of(counts, "aspect", whole.select("total_rows").scalar()),
        "nulls": by_aspect,
        "texts": whole.select("total_rows", *texts),
        "identity": audit.ids_against_texts(rows),
        "duplicates": duplicates.duplicate_summary(rows),
        "cross_hotel": duplicates.cross_hotel_examples(rows),
    }


def analyse_trends(spark: SparkSession, aspects: str, output: str) -> Reports:
    """Monthly trends overall and per hotel, stored below ``output``; the largest moves as report."""
    rows = _table(spark, aspects)
    overall, hotels = f"{output}/global", f"{output}/hotel"
    both, by_hotel = trends.trends_of_both_levels(rows)
    found = trends.in_trend_order(both)
    sinks.write_csv(found, overall)
    sinks.write_csv(trends.in_trend_order(by_hotel), hotels)
    stored = delimited.read_csv(spark, overall, found.schema)
    return {
        "rises": trends.top_movers(stored),
        "falls": trends.top_movers(stored, rises=False),
        "chart": trends.chart_series(stored),
    }


def make_splits(spark: SparkSession, aspects: str, output: str) -> Reports:
    """Review-level and hotel-level splits, each stored with one folder per split."""
    rows = _table(spark, aspects)
    by_review, by_hotel = f"{output}/review", f"{output}/hotel"
    sinks.write_parquet(splits.review_split(rows), by_review, split_column="split")
    sinks.write_parquet(splits.hotel_split(rows), by_hotel, split_column="split")
    return {
        "review": splits.split_report(spark.read.parquet(by_review), group="review_id"),
        "hotel": splits.split_report(spark.read.parquet(by_hotel)),
    }


def prepare_labelled(spark: SparkSession, tsv: str, output: str) -> Reports:
    """Labelled sentences to recoded CSV splits."""
    rows = delimited.read_labelled_tsv(prepare(spark), tsv)
    recoded = rows.select("id", recode_polarity(F.col("label")).alias("label"), "text", "split")
    routed = splits.routed(recoded)
    sinks.write_csv(routed, output, split_column="split")
    return {"splits": frequency.by_value(frequency.frequencies(routed, "split"))}


def profile_labelled(spark: SparkSession, tsv: str) -> Reports:
    """Shape, missing values, duplicates, distributions and text lengths of the labelled sentences."""
    rows = delimited.read_labelled_tsv(prepare(spark), tsv)
    return {
        "shape": assets.overview(rows),
        "missing": audit.null_counts(rows),
        "repeated": audit.repeated_rows(rows),
        "values": frequency.value_samples(rows),
        "splits": frequency.by_count(frequency.shares(rows, "split")),
        "labels": frequency.by_value(frequency.shares(rows, "label")),
        "labels_by_split": frequency.contingency(rows, "split", "label"),
        "lengths": audit.length_summary(rows, "text"),
        "empty": audit.empty_texts(rows, "text"),
    }


def audit_assets(spark: SparkSession, **assets_by_name: str) -> Reports:
    """Existence, shape, columns and labels of stored tables, given as name=path."""
    return {
        "overview": assets.asset_overview(prepare(spark), assets_by_name),
        "labels": assets.asset_labels(spark, assets_by_name),
    }


def build_vocabulary(
    spark: SparkSession,
    texts: str,
    output: str,
    column: str = "comment",
    size: int = SUBWORD_VOCABULARY,
    max_chars: int = vocabulary.MAX_PIECE_CHARS,
) -> Reports:
    """Train and store the subword vocabulary of a text column; pieces have at most ``max_chars`` characters."""
    sinks.write_parquet(vocabulary.train_vocabulary(_table(spark, texts), column, int(size), int(max_chars)), output)
    return {"head": vocabulary.vocabulary_head(spark.read.parquet(output))}


def compare_tokens(spark: SparkSession, texts: str, vocabulary_path: str, column: str = "comment", key: str = "review_id") -> Reports:
    """Token counts at three granularities, and ten texts cut all three ways."""
    rows, known = _table(spark, texts), spark.read.parquet(vocabulary_path)
    return {
        "statistics": features.token_statistics(rows, column, known),
        "preview": features.token_preview(rows.select(key, column), column, known, [key]),
    }


def build_features(spark: SparkSession, research: str, vocabulary_path: str, output: str, length: int = SEQUENCE_LENGTH) -> Reports:
    """Store one feature row per aspect record of the research corpus."""
    known = spark.read.parquet(vocabulary_path)
    sinks.write_parquet(features.corpus_features(_table(spark, research), known, int(length)), output)
    return {"rows": spark.read.parquet(output).agg(F.count(F.lit(1)).alias("rows"))}


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_key", F.concat_ws("/", "review_id", "aspect"))


def _fit(spark: SparkSession, train: DataFrame, held_out: DataFrame, vocabulary_path: str, model: str, **options) -> Reports:
    """Train on a balanced sample, select on rows left as they are, and report from the stored model."""
    known = spark.read.parquet(vocabulary_path)
    drawn = sampling.balanced_sample(_keyed(train), "row_key", "sentiment_label")
    test = classifier.examples(held_out, known)
    classifier.select_model(classifier.examples(drawn, known), test, model, **options)
    predicted_path = fresh_path(spark, "predicted")
    sinks.write_parquet(classifier.score(classifier.load_model(spark, model), test), predicted_path)
    predicted = spark.read.parquet(predicted_path)
    return {"metrics": evaluation.metric_report(predicted), "confusion": evaluation.confusion_matrix(predicted)}


def train_classifier(spark: SparkSession, split_table: str, vocabulary_path: str, model: str, **options) -> Reports:
    """Train on the train split of a stored split table, validate on its val split, store the best model."""
    rows = _table(spark, split_table)
    train, held_out = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")
    return {
        "splits": splits.split_report(rows.where(F.col("split").isin("train", "val"))),
        "batches": sampling.batch_composition(train, "sentiment_label"),
        **_fit(spark, train, held_out, vocabulary_path, model, **options),
    }


def try_classifier(spark: SparkSession, split_table: str, vocabulary_path: str, model: str, **options) -> Reports:
    """The same on a small capped subset of the train split, cut 80/20 within classes."""
    train = _table(spark, split_table).where(F.col("split") == "train").drop("split")
    subset = sampling.capped_subset(_keyed(train), "sentiment_label", ["review_id", "aspect"])
    path = fresh_path(spark, "subset")
    sinks.write_parquet(splits.stratified_split(subset, "row_key", "sentiment_label"), path)
    rows = spark.read.parquet(path)
    train, held_out = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")
    return _fit(spark, train, held_out, vocabulary_path, model, **options)


def diagnose_classifier(spark: SparkSession, split_table: str, vocabulary_path: str, model: str) -> Reports:
    """Confusion matrix and metrics of a stored model on the val split."""
    held_out = _table(spark, split_table).where(F.col("split") == "val")
    test = classifier.examples(held_out, spark.read.parquet(vocabulary_path))
    predicted = classifier.score(classifier.load_model(spark, model), test)
    return {"confusion": evaluation.confusion_matrix(predicted), "metrics": evaluation.metric_report(predicted)}


JOBS = {
    job.__name__: job
    for job in (
        collect_pages,
        collect_lines,
        build_research,
        build_aspects,
        profile_research,
        check_quality,
        analyse_trends,
        make_splits,
        prepare_labelled,
        profile_labelled,
        audit_assets,
        build_vocabulary,
        compare_tokens,
        build_features,
        train_classifier,
        try_classifier,
        diagnose_classifier,
    )
}
