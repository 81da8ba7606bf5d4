"""Confusion matrix, accuracy and macro-F1 of predictions ``(logits, aspect_idx, label)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.domain import LABELS
from kuchikomi.functions.predictions import predicted_class
from kuchikomi.functions.scores import aspect_label


def with_predictions(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("predicted", predicted_class(F.col(logits)))


def outcome_counts(predicted: DataFrame, *by: str) -> DataFrame:
    """Rows per true and predicted class (and ``by``): the one pass all metrics derive from."""
    return predicted.groupBy(*by, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predicted: DataFrame) -> DataFrame:
    """``(true_label, pred_label, n)`` for every pair of classes, empty cells included."""
    cells = [(t, p) for t in LABELS for p in LABELS]
    counted = predicted.agg(
        *[F.count_if((F.col("label") == t) & (F.col("predicted") == p)).alias(f"c{t}{p}") for t, p in cells]
    )
    long = F.array(
        *[
            F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.col(f"c{t}{p}").alias("n"))
            for t, p in cells
        ]
    )
    return counted.select(F.explode(long).alias("cell")).select("cell.*")


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


def class_f1(counts: DataFrame, *by: str) -> DataFrame:
    """F1 of each class that occurs as truth or as prediction, from outcome counts."""
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
    )
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    return (
        counts.select(*by, hit.alias("hit"), F.explode(roles).alias("role"))
        .groupBy(*by, F.col("role.class").alias("class"))
        .agg(
            # A correct row appears once as truth and once as prediction, hence 2 tp = sum(hit).
            (F.sum("hit") / (F.sum("role.support") + F.sum("role.claimed"))).alias("f1"),
            F.sum("role.support").alias("support"),
        )
    )


def macro_f1(predicted: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean of the class F1s; classes neither present nor predicted do not count."""
    scored = class_f1(outcome_counts(predicted, *by), *by)
    mean = F.avg("f1").alias("macro_f1")
    return scored.groupBy(*by).agg(mean) if by else scored.agg(mean)


def aspect_macro_f1(predicted: DataFrame) -> DataFrame:
    """Macro-F1 of each aspect present, with the classes seen in that aspect."""
    return macro_f1(predicted, "aspect_idx").select(
        "aspect_idx", aspect_label(F.col("aspect_idx")).alias("aspect"), "macro_f1"
    )


def metric_report(predicted: DataFrame) -> DataFrame:
    """Accuracy, macro-F1 and macro-F1 per aspect as ``(metric, value)``.

    Everything follows from one table of counts per aspect, true and predicted class.
    """
    counts = outcome_counts(predicted, "aspect_idx")
    overall = counts.groupBy("label", "predicted").agg(F.sum("n").alias("n"))
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    parts = [
        overall.agg((right / F.sum("n")).alias("value")).select(F.lit("accuracy").alias("metric"), "value"),
        class_f1(overall).agg(F.avg("f1").alias("value")).select(F.lit("macro_f1").alias("metric"), "value"),
        class_f1(counts, "aspect_idx")
        .groupBy("aspect_idx")
        .agg(F.avg("f1").alias("value"))
        .select(F.concat(F.lit("macro_f1_"), aspect_label(F.col("aspect_idx"))).alias("metric"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
