from __future__ import annotations

import json

from kuchikomi.operators import collection
from kuchikomi.streaming import ingest


def _deliver(folder, name, reviews):
    lines = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in reviews]
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf8")


def _run(spark, folder, tmp_path):
    ingest.ingest(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "progress")).awaitTermination()
    return ingest.collected(spark, str(tmp_path / "table"))


def test_two_deliveries_store_each_id_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _deliver(folder, "hotel_1_reviews.jsonl", [{"id": 1, "postDateTime": "b"}, {"id": 1, "postDateTime": "a"}, "{broken", "", {"title": "no id"}, {"id": ""}])
    first = _run(spark, folder, tmp_path)
    assert [(r.id, r.postDateTime, r.hotel_id) for r in first.collect()] == [("1", "a", "1")]
    _deliver(folder, "hotel_2_reviews.jsonl", [{"id": "1", "postDateTime": "0"}, {"id": "2", "comment": "良い"}])
    second = _run(spark, folder, tmp_path).orderBy("id", "hotel_id").collect()
    assert [(r.id, r.hotel_id, r.comment) for r in second] == [("1", "1", None), ("1", "2", None), ("2", "2", "良い")]
    assert len(_run(spark, folder, tmp_path).collect()) == 3


def test_repeated_batch_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = spark.createDataFrame([("a", "h", "1"), ("a", "h", "0"), ("b", "h", "1")], "id string, hotel_id string, postDateTime string")
    ingest.append_new(batch, table)
    ingest.append_new(batch, table)
    assert sorted((r.id, r.postDateTime) for r in spark.read.parquet(table).collect()) == [("a", "0"), ("b", "1")]


def test_state_store_variant(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _deliver(folder, "hotel_1_reviews.jsonl", [{"id": i % 3} for i in range(30)])
    unique = ingest.unique_stream(ingest.new_reviews(ingest.read_line_stream(spark, str(folder))))
    query = (
        unique.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "2"]


def test_pages_in_sequence_first_seen_wins(spark):
    rows = spark.createDataFrame([("x", 2, 0), ("x", 1, 19), ("y", 1, 0), (None, 1, 3)], "id string, page int, position int")
    first = collection.first_per_key(collection.identified(rows), "id", ["page", "position"])
    assert sorted(tuple(r) for r in first.collect()) == [("x", 1, 19), ("y", 1, 0)]


def test_append_counts_and_keys(spark, tmp_path):
    table = str(tmp_path / "table")
    schema = "id string, hotel_id string, postDateTime string"
    assert ingest.append_new(spark.createDataFrame([("a", "h", "1"), ("b", "h", "1"), ("b", None, "1")], schema), table) == 3
    later = spark.createDataFrame([("b", "h", "0"), ("b", "x", "0"), ("c", "x", "0"), ("c", "x", "1"), ("b", None, "0")], schema)
    assert ingest.append_new(later, table) == 2
    held = {(r.id, r.hotel_id, r.postDateTime) for r in ingest.collected(spark, table).collect()}
    assert held == {("a", "h", "1"), ("b", "h", "1"), ("b", None, "1"), ("b", "x", "0"), ("c", "x", "0")}


def test_append_reads_only_touched_folders(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = spark.range(500).selectExpr("cast(id as string) as id", "'h' as hotel_id", "'1' as postDateTime")
    assert ingest.append_new(rows, table) == 500
    stored = spark.read.parquet(table).where("bucket in (3)")
    assert "PartitionFilters: [bucket" in stored._jdf.queryExecution().toString().replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket")
    assert 0 < stored.count() < 50
