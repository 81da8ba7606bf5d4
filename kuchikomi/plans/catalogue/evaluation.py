"""Predictions, metrics and the baseline classifier."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS
from kuchikomi.operators import classifier, evaluation, passes, sampling, splits
from kuchikomi.plans import views
from kuchikomi.plans.catalogue.registry import query
from kuchikomi.session import fresh_path


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_predictions(views.predictions(spark, sf_dir))


@query("P23", "select vec_id, predicted from predictions", (views.PREDICTIONS_SQL,))
def predicted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select("vec_id", "predicted")


@query(
    "A23",
    """select t.k as true_label, p.k as pred_label, count(x.vec_id) as n
       from (values (0), (1), (2)) t(k) cross join (values (0), (1), (2)) p(k)
       left join predictions x on x.label = t.k and x.predicted = p.k group by t.k, p.k""",
    (views.PREDICTIONS_SQL,),
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(_predicted(spark, sf_dir))


@query("A24", "select avg((label = predicted)::integer) as accuracy from predictions", (views.PREDICTIONS_SQL,))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_predicted(spark, sf_dir))


_F1_SQL = """
by_class as (
  select aspect_idx, k, 2 * sum(tp)::double / (sum(support) + sum(claimed)) as f1 from (
    select aspect_idx, label as k, (label = predicted)::integer as tp, 1 as support, 0 as claimed from graded
    union all select aspect_idx, predicted, 0, 0, 1 from graded) group by aspect_idx, k),
macro as (select aspect_idx, round(avg(f1), 9) as macro_f1 from by_class group by aspect_idx)
"""
_OVERALL = "graded as (select label, predicted, 0 as aspect_idx from predictions)"
_PER_ASPECT = "graded as (select label, predicted, aspect_idx from predictions)"
_NAME = "case aspect_idx " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(ASPECTS)) + " else aspect_idx::varchar end"


@query("A25", "select macro_f1 from macro", (views.PREDICTIONS_SQL, _OVERALL, _F1_SQL))
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro_f1(_predicted(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(
    "A26 P20 F10",
    f"select aspect_idx, {_NAME} as aspect, macro_f1 from macro",
    (views.PREDICTIONS_SQL, _PER_ASPECT, _F1_SQL),
)
def macro_f1_by_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aspect_macro_f1(_predicted(spark, sf_dir)).withColumn("macro_f1", F.round("macro_f1", 9))


_TOTAL_F1_SQL = _F1_SQL.replace("by_class", "total_class").replace("macro as", "total_macro as").replace(
    "from graded", "from (select label, predicted, 0 as aspect_idx from predictions)"
)


@query(
    "M3",
    f"""select 'accuracy' as metric, round(avg((label = predicted)::integer), 9) as value from predictions
        union all select 'macro_f1', macro_f1 from total_macro
        union all select 'macro_f1_' || {_NAME}, macro_f1 from macro""",
    (views.PREDICTIONS_SQL, _PER_ASPECT, _F1_SQL, _TOTAL_F1_SQL),
)
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metric_report(_predicted(spark, sf_dir)).withColumn("value", F.round("value", 9))


_HELD_OUT_SQL = """
classes as (select doc_id, (case when toxic = 1 then 0 when quality = 0 then 1 else 2 end) as label
            from labels where doc_id in (select doc_id from documents)),
placed as (select *, row_number() over (partition by label order by md5(doc_id || '|42'), doc_id::varchar) as place,
                  count(*) over (partition by label) as total from classes),
held_out as (select * from placed where place > total - ceil(0.2::double * total))
"""


def _labelled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in three classes, cut 80/20 within each."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = views.quality_rows(spark, sf_dir).join(documents, "doc_id").select(
        F.col("doc_id").alias("review_id"),
        F.get(F.array(*[F.lit(a) for a in ASPECTS]), (F.col("doc_id") % len(ASPECTS)).cast("int")).alias("aspect"),
        F.col("text").alias("comment"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("sentiment_label"),
    )
    return splits.stratified_split(rows, "review_id", "sentiment_label")


def _of_majority(counts: DataFrame) -> float:
    """Macro-F1 of calling everything the largest class: one class with its share as precision and full recall."""
    share = counts.agg(F.max("value") / F.sum("value")).first()[0]
    return 2 * share / (1 + share) / 3


@query(
    "M1 M2 M3 M4 D3 D5 A25",
    """select 'held_out_' || label as fact, count(*)::double as value from held_out group by label
       union all select 'scored', count(*) from held_out
       union all select fact, 1.0 from (values ('reloaded_equals_fitted'), ('best_of_grid'), ('beats_majority')) t(fact)""",
    (_HELD_OUT_SQL,),
)
def classifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on labelled documents, classes balanced by weight, select by macro-F1, store, reload and check the model."""
    split = _labelled_split(spark, sf_dir).persist(StorageLevel.DISK_ONLY)
    vocabulary = views.stored_vocabulary(spark, sf_dir)
    train = sampling.inverse_weights(classifier.examples(split.where(F.col("split") == "train"), vocabulary), "label")
    # Tokens take some thirty times the space of their text: they are made again for each use, and predictions are kept.
    held_out = classifier.examples(split.where(F.col("split") == "val"), vocabulary)
    path = fresh_path(spark, "model")
    fitted, best = classifier.select_model(train, held_out, path, weight="weight")
    predicted = {name: classifier.score(model, held_out).persist() for name, model in (("fitted", fitted), ("stored", classifier.load_model(spark, path)))}
    same = predicted["fitted"].select("review_id", "predicted").exceptAll(predicted["stored"].select("review_id", "predicted")).isEmpty()
    reached = evaluation.macro_f1(predicted["stored"]).first()["macro_f1"]
    counts = held_out.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("value"))
    facts = {"reloaded_equals_fitted": same, "best_of_grid": abs(reached - best) < 1e-12, "beats_majority": reached > _of_majority(counts)}
    checked = spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "fact string, value double")
    by_class = counts.select(F.concat(F.lit("held_out_"), "label").alias("fact"), "value")
    scored = predicted["stored"].agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("scored").alias("fact"), "value")
    return by_class.unionByName(scored).unionByName(checked)


@query(
    "M2 (best of the passes of one run) M4 D3 A25",
    """select 'held_out_' || label as fact, count(*)::double as value from held_out group by label
       union all select fact, 1.0 from (values ('states_agree'), ('best_is_highest'), ('beats_majority'), ('passes_differ')) t(fact)""",
    (_HELD_OUT_SQL,),
)
def training_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train in passes, each stored and judged; every stored state gives the figures of its pass again."""
    split = _labelled_split(spark, sf_dir)
    vocabulary, path = views.stored_vocabulary(spark, sf_dir), fresh_path(spark, "passes")
    weighted = sampling.inverse_weights(classifier.examples(split.where(F.col("split") == "train"), vocabulary), "label")
    # Weights of one on average: inverse class sizes times a third of all rows.
    rows = weighted.agg(F.count(F.lit(1))).scalar()
    train = passes.prepared(weighted.withColumn("weight", F.col("weight") * rows / 3)).persist(StorageLevel.DISK_ONLY)
    held_out = passes.prepared(classifier.examples(split.where(F.col("split") == "val"), vocabulary)).persist(StorageLevel.DISK_ONLY)
    best, reached = passes.train_in_passes(train, held_out, path)
    again = [evaluation.macro_f1(passes.scored(held_out, passes.stored_state(spark, path, n))).first()["macro_f1"] for n in range(1, len(reached) + 1)]
    counts = held_out.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("value"))
    facts = {
        "states_agree": max(abs(a - b) for a, b in zip(again, reached)) < 1e-12,
        "best_is_highest": again[best - 1] == max(again),
        "beats_majority": reached[best - 1] > _of_majority(counts),
        "passes_differ": len(set(reached)) > 1 or min(reached) == 1.0,
    }
    checked = spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "fact string, value double")
    return counts.select(F.concat(F.lit("held_out_"), "label").alias("fact"), "value").unionByName(checked)
