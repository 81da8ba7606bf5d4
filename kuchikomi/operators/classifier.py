"""Baseline sentiment classifier over the three granularities, with Spark ML."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS
from kuchikomi.functions.scores import aspect_index
from kuchikomi.functions.tokens import char_tokens, word_tokens
from kuchikomi.operators.evaluation import macro_f1, with_predictions
from kuchikomi.operators.vocabulary import encode

REGULARISATION = (0.001, 0.01, 0.1)


def examples(aspects: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token columns, aspect id and label of each aspect row; unknown aspects share a category of their own."""
    index = aspect_index(F.col("aspect"))
    return encode(aspects, "comment", vocabulary).select(
        "review_id",
        "aspect",
        index.alias("aspect_idx"),
        F.when(index < 0, len(ASPECTS)).otherwise(index).alias("aspect_category"),
        F.col("sentiment_label").alias("label"),
        char_tokens(F.col("comment")).alias("chars"),
        F.col("subword_pieces").alias("subwords"),
        word_tokens(F.col("comment")).alias("words"),
    )


def featuriser(features: int = 1 << 14) -> Pipeline:
    """Hashed character pairs, subwords and words, and the aspect one-hot, as one vector."""
    return Pipeline(
        stages=[
            NGram(n=2, inputCol="chars", outputCol="char_pairs"),
            HashingTF(numFeatures=features, inputCol="char_pairs", outputCol="f_chars"),
            HashingTF(numFeatures=features, inputCol="subwords", outputCol="f_subwords"),
            HashingTF(numFeatures=features, inputCol="words", outputCol="f_words"),
            OneHotEncoder(inputCol="aspect_category", outputCol="f_aspect", dropLast=False, handleInvalid="keep"),
            VectorAssembler(inputCols=["f_chars", "f_subwords", "f_words", "f_aspect"], outputCol="features"),
        ]
    )


def known_categories(spark: SparkSession) -> DataFrame:
    """One row per aspect category: all that the one-hot encoder has to see."""
    n = len(ASPECTS) + 1
    empty = F.array().cast("array<string>")
    return spark.range(n).select(F.col("id").cast("int").alias("aspect_category"), *[empty.alias(c) for c in ("chars", "subwords", "words")])


def regression(reg_param: float, weight: str | None = None, max_iter: int = 30) -> LogisticRegression:
    """Multinomial logistic regression. Balance the classes by drawing the rows or by ``weight``, not both.

    Counts are not standardised: a slot seen once would otherwise weigh as much as the words that tell the classes apart.
    """
    estimator = LogisticRegression(
        family="multinomial", regParam=reg_param, maxIter=max_iter, featuresCol="features", labelCol="label", standardization=False
    )
    return estimator.setWeightCol(weight) if weight else estimator


def score(model: Transformer, rows: DataFrame) -> DataFrame:
    """Predictions as ``(logits, aspect_idx, label, predicted)``."""
    scored = model.transform(rows).select(
        "review_id", vector_to_array("rawPrediction").alias("logits"), "aspect_idx", "label"
    )
    return with_predictions(scored)


def select_model(
    train: DataFrame,
    validation: DataFrame,
    path: str,
    grid: tuple[float, ...] = REGULARISATION,
    features: int = 1 << 14,
    weight: str | None = None,
    max_iter: int = 30,
) -> tuple[PipelineModel, float]:
    """Fit each candidate, store the one with the best macro-F1 on the validation rows, return it and its score.

    The first candidate wins a tie. Texts are turned into vectors once for all candidates; the featuriser learns
    nothing from the rows (the categories are the aspects and one more), so it needs no pass of its own. Vectors are several times
    as large as the texts and lie on disk, so that what an executor holds in memory does not grow with the rows.
    """
    vectors = featuriser(features).fit(known_categories(train.sparkSession))
    columns = ["features", "label", *([weight] if weight else [])]
    fitted = vectors.transform(train).select(*columns).persist(StorageLevel.DISK_ONLY)
    held_out = vectors.transform(validation).select("review_id", "features", "aspect_idx", "label")
    held_out = held_out.persist(StorageLevel.DISK_ONLY)
    best, best_f1 = None, -1.0
    try:
        for reg_param in grid:
            candidate = regression(reg_param, weight, max_iter).fit(fitted)
            f1 = macro_f1(score(candidate, held_out)).first()["macro_f1"] or 0.0
            if f1 > best_f1:
                best, best_f1 = candidate, f1
    finally:
        fitted.unpersist()
        held_out.unpersist()
    model = PipelineModel(stages=[*vectors.stages, best])
    model.write().overwrite().save(path)
    return model, best_f1


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.read().load(path)
