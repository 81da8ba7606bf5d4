"""What keeps tasks small on large tables; every test builds its own rows."""

from __future__ import annotations

import inspect

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from kuchikomi.operators import classifier, duplicates, passes
from kuchikomi.operators.vocabulary import encode
from kuchikomi.plans import views
from kuchikomi.plans.catalogue import QUERIES, collection, evaluation
from kuchikomi.session import BATCH_LIMITS
from kuchikomi.sources import review_lines, sinks


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture
def folder(spark, tmp_path):
    documents = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text of number "), F.sha2(F.col("id").cast("string"), 512)).alias("text"),
        F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, "src1").otherwise("src0").alias("source"),
        (F.col("id") + 1).alias("n_chars"),
    )
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.range(0, 400, 2).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_larger_tables_are_dealt_wider(spark, folder, monkeypatch):
    assert views.table(spark, folder, "documents").rdd.getNumPartitions() == views.FIXTURE_PARTITIONS
    monkeypatch.setattr(views, "PARTITION_BYTES", 2_000)
    assert views.table(spark, folder, "documents").rdd.getNumPartitions() > 2 * views.FIXTURE_PARTITIONS
    assert views.table(spark, folder, "documents").count() == 400


def test_classifier_report_is_the_whole_job(monkeypatch):
    sql = QUERIES["classifier_report"].sql
    assert "beats_majority" in sql and "reaches_majority" not in sql
    called = inspect.getsource(evaluation.classifier_report)
    assert "select_model(train, held_out, path, weight=" in called and "features=" not in called and "max_iter=" not in called and "reaches" not in called


def test_few_telling_counts_beat_the_majority(spark):
    """Seen-once slots by the hundred must not drown the word that tells the classes apart."""
    rows = [(str(i), "room", f"{'awful' if i % 5 == 0 else 'lovely'} " + " ".join(f"w{i}x{j}" for j in range(60)), 0 if i % 5 == 0 else 2) for i in range(60)]
    aspects = spark.createDataFrame(rows, "review_id string, aspect string, comment string, sentiment_label int")
    assert not classifier.regression(0.01).getStandardization()
    words = F.split("comment", " ")
    table = aspects.select("review_id", F.lit(0).alias("aspect_idx"), F.lit(0).alias("aspect_category"), F.col("sentiment_label").alias("label"), F.split("comment", "").alias("chars"), words.alias("subwords"), words.alias("words"))
    vectors = classifier.featuriser(1 << 10).fit(classifier.known_categories(spark))
    fitted = classifier.regression(0.01).fit(vectors.transform(table.where("cast(review_id as int) < 40")))
    judged = classifier.score(fitted, vectors.transform(table.where("cast(review_id as int) >= 40")))
    assert judged.where("label = 0 and predicted = 0").count() > 0


def test_a_folder_of_parts_is_one_file(spark, tmp_path):
    lines = spark.range(100).select(F.lit("hotel_a_reviews.jsonl").alias("file_name"), F.lit("{}").alias("line"))
    sinks.append_text(lines.repartition(4), "line", f"{tmp_path}/lines", split_column="file_name")
    (tmp_path / "lines" / "hotel_b_reviews.jsonl").write_text("{}")
    found = {r.hotel_id: r.files for r in review_lines.files_read(spark, f"{tmp_path}/lines/*").collect()}
    assert found == {"a": 1, "b": 1}


def test_review_files_are_not_written_by_one_task(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr(sinks, "append_text", lambda df, *a, **k: (written.append(df), _append(df, *a, **k))[1])
    rows = {r.hotel_id: r for r in QUERIES["review_files"].run(spark, folder).collect()}
    assert "SinglePartition" not in plan(written[0]) and "Repartition 1" not in plan(written[0])
    assert {h: r.files for h, r in rows.items()} == {"src0": 1, "src1": 1, "blank": 1}
    assert sum(r.input_reviews or 0 for r in rows.values()) == 400


_append = sinks.append_text


@pytest.mark.parametrize("name", ["incremental_ingest", "three_deliveries"])
def test_deliveries_are_written_without_a_shuffle(spark, folder, monkeypatch, name):
    written = []
    monkeypatch.setattr(collection.sinks, "append_text", lambda df, *a, **k: (written.append(df), _append(df, *a, **k))[1])
    held = QUERIES[name].run(spark, folder).select("id", "hotel_id").collect()
    assert len(written) == (2 if name == "incremental_ingest" else 3)
    assert not any("RepartitionByExpression" in plan(df) for df in written)
    broken = {i for i in range(0, 400, 2) if i % 4}
    expected = [(str(i), "src1" if i % 3 == 0 else "src0") for i in range(400) if i not in broken] + [(str(i), "other") for i in range(0, 400, 10) if i not in broken]
    assert sorted(map(tuple, held)) == sorted(expected)


def test_equal_rows_of_a_review_are_not_sorted(spark):
    one = spark.createDataFrame([("a", "h", "x"), ("b", "i", "x"), ("c", None, None)], "review_id string, hotel_name string, comment string")
    rows = one.crossJoin(spark.range(8))
    ranked = plan(duplicates._one_row_per_review(rows, "review_id", None, 50))
    assert "HashAggregate" in ranked
    assert tuple(duplicates.duplicate_summary(rows).first()) == (1, 1)


def test_lines_are_read_once(spark):
    """Accepting lines does not read them again below the filter, and the second element tells where an object ends."""
    good = '{"id":"1","comment":"c","scores":[{"code":"ROOM","score":3}]}'
    bad = [good + " x", good + good, good + "," + good, good + "] " + good, good[:-3], good + ',{"mark":"1"}] {}', "[" + good + "]", "5"]
    lines = spark.createDataFrame([("hotel_a_reviews.jsonl", t) for t in [good, f" {good} ", "{}", *bad]], "file_name string, line string")
    parsed = review_lines.parse_review_lines(lines)
    assert [(r.id, r.comment) for r in review_lines.accepted(parsed).collect()] == [("1", "c"), ("1", "c"), (None, None)]
    assert [r.line for r in review_lines.rejected(parsed).collect()] == bad
    plan = review_lines.accepted(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(overallScore,") == 1


def test_orders_are_dealt_by_their_rows(spark, tmp_path):
    """Orders are narrow: 8 MB of them are far more rows than of other tables, so their partitions are cut sooner."""
    spark.range(3_000_000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    orders = views.table(spark, str(tmp_path), "orders")
    assert orders.rdd.getNumPartitions() > views.FIXTURE_PARTITIONS and orders.count() == 3_000_000


@pytest.fixture
def kept_in_memory(spark, monkeypatch):
    """Columns of every table that a query keeps in memory."""
    frame, columns = type(spark.range(0)), set()
    persist = frame.persist

    def seen(self, level=StorageLevel.MEMORY_AND_DISK_DESER):
        columns.update(self.columns if level.useMemory else ())
        return persist(self, level)

    monkeypatch.setattr(frame, "persist", seen)
    return columns


WIDE = {"comment", "text", "chars", "subwords", "words", "slots", "features"}


def test_texts_tokens_and_vectors_of_the_classifier_are_not_kept_in_memory(spark, folder, kept_in_memory, monkeypatch):
    regression = classifier.regression
    monkeypatch.setattr(classifier, "regression", lambda reg_param, weight, max_iter: regression(reg_param, weight, 2))
    found = {r.fact: r.value for r in QUERIES["classifier_report"].run(spark, folder).collect()}
    assert "predicted" in kept_in_memory and not kept_in_memory & WIDE
    assert found["scored"] == sum(v for k, v in found.items() if k.startswith("held_out_")) == 40
    assert found["reloaded_equals_fitted"] == found["best_of_grid"] == 1.0


@pytest.mark.parametrize("setting, most, less", [("maxRecordsPerBatch", ["10000", "0"], "7"), ("maxBytesPerBatch", ["64m", "2147483647"], "1k")])
def test_batches_of_texts_are_bounded(spark, setting, most, less):
    setting = f"spark.sql.execution.arrow.{setting}"
    vocabulary = spark.createDataFrame([(4, "a", 1)], "id int, piece string, n bigint")
    texts = spark.createDataFrame([("ab",), (None,)], "comment string")
    before = spark.conf.get(setting)
    try:
        for given, expected in [*((m, str(BATCH_LIMITS[setting])) for m in most), (less, less)]:
            spark.conf.set(setting, given)
            assert [r.subword_ids for r in encode(texts, "comment", vocabulary).collect()] == [[4, 1], None]
            assert spark.conf.get(setting) == expected
    finally:
        spark.conf.set(setting, before)


def test_slots_of_training_rows_are_not_kept_in_memory(spark, folder, kept_in_memory, monkeypatch):
    train = passes.train_in_passes
    monkeypatch.setattr(passes, "train_in_passes", lambda *tables: train(*tables, passes=1))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    found = {r.fact: r.value for r in QUERIES["training_passes"].run(spark, folder).collect()}
    assert not kept_in_memory & WIDE and found["states_agree"] == found["best_is_highest"] == 1.0
    assert sum(v for k, v in found.items() if k.startswith("held_out_")) == 40
    one = spark.createDataFrame([("a", 0, 0, [1], 1.0)], "review_id string, aspect_idx int, label int, slots array<int>, weight double")
    for read in (lambda: passes.one_pass(one, np.zeros((8, 3)), 0.1), lambda: passes.scored(one, np.zeros((8, 3)))):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        read()
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(2 << 20)
