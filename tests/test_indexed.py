from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from kuchikomi.operators import collection, splits
from kuchikomi.plans import jobs
from kuchikomi.streaming import indexed

SCHEMA = "id string, hotel_id string, postDateTime string"


def keys_of(batch):
    return batch.select(collection.key_hash(indexed.KEY).alias(indexed.HASH)).distinct()


def ids(spark, first, last, hotel="h"):
    return spark.range(first, last).selectExpr("cast(id as string) as id", f"'{hotel}' as hotel_id", "'1' as postDateTime")


def test_addresses_follow_the_number_of_buckets(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(63) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "h bigint")
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 31):
        own = [indexed.address(v, n) for v in values]
        assert [r.b for r in rows.select(indexed.bucket_of(F.col("h"), n).alias("b")).collect()] == own
        assert set(own) <= set(range(n)) and len(set(own)) == n
        # One more bucket takes keys from a single one.
        moved = {a for a, v in zip(own, values) if indexed.address(v, n + 1) != a}
        assert moved <= {indexed.address(n, n)}


def test_each_key_once_over_many_deliveries(spark, tmp_path):
    """Against a plain set, with buckets that split and runs that are merged."""
    table, held, rng = str(tmp_path / "t"), {}, random.Random(4)
    for _ in range(12):
        rows = [(rng.choice([None, "", *map(str, range(400))]), rng.choice([None, "a", "b"]), str(rng.randint(0, 3))) for _ in range(rng.randint(0, 90))]
        new = {}
        for i, h, t in rows:
            if (h, i) not in held:
                new[h, i] = min(t, new.get((h, i), t))
        assert indexed.append_indexed(spark.createDataFrame(rows, SCHEMA), table, keys_per_bucket=40) == len(new)
        held |= new
    assert {(r.hotel_id, r.id): r.postDateTime for r in indexed.collected_indexed(spark, table).collect()} == held
    state = indexed.latest(spark, table)
    assert state.keys == len(held) and state.buckets == -(-len(held) // 40) > 8
    assert max(map(len, state.runs.values())) <= indexed.MOST_RUNS
    stored = indexed._read(spark, table, "keys", [(r, b) for b, rs in state.runs.items() for r in rs], indexed.KEY_SCHEMA)
    assert stored.count() == len(held)
    assert all(indexed.address(r._hash, state.buckets) == r.bucket for r in stored.collect())


def test_keys_read_do_not_grow_with_history(spark, tmp_path):
    table, read = str(tmp_path / "t"), []
    for step in range(4):
        indexed.append_indexed(ids(spark, step * 4000, step * 4000 + 4000), table, keys_per_bucket=500)
        state = indexed.latest(spark, table)
        read.append(indexed.held_keys(spark, table, state, keys_of(ids(spark, 10**6, 10**6 + 20))).count())
        again = indexed.possible_places(spark, table, state, keys_of(ids(spark, 5, 6)))
        assert len(again) == 1 and indexed.held_keys(spark, table, state, keys_of(ids(spark, 5, 6))).where("id = '5'").count() == 1
    assert state.keys == 16000 and max(read) <= 4 * 500


def test_an_unfinished_delivery_is_written_again(spark, tmp_path):
    table = str(tmp_path / "t")
    assert indexed.append_indexed(ids(spark, 0, 30), table) == 30
    for tree, rows in (("delivery=2", ids(spark, 500, 600)), ("_index/keys/run=2", ids(spark, 500, 600))):
        rows.write.parquet(f"{table}/{tree}")
    assert indexed.collected_indexed(spark, table).count() == 30
    assert indexed.append_indexed(ids(spark, 20, 50), table) == 20
    assert indexed.append_indexed(ids(spark, 20, 50), table) == 0
    assert indexed.collected_indexed(spark, table).count() == 50
    assert indexed.append_indexed(spark.createDataFrame([("x", "1")], "id string, postDateTime string").withColumn("hotel_id", F.lit(None).cast("string")).select("id", "hotel_id", "postDateTime"), table) == 1


def test_rows_of_single_keys_are_not_moved(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = [(f"k{i}", i % 7, "x" * 50) for i in range(300)] + [("k5", 0, "first"), ("k6", 9, "last"), (None, 1, "n"), (None, 0, "null")] + [("k8", 1, "x" * 50)] * 2
    spark.createDataFrame(rows, "k string, place int, wide string").write.parquet(path)
    stored = spark.read.parquet(path)
    key = lambda r: (r.k or "", r.place, r.wide)
    late, plain = collection.first_of_key(stored, ["k"], ["place"]), collection.first_per_key(stored, "k", ["place"])
    assert sorted(late.collect(), key=key) == sorted(plain.collect(), key=key)
    assert late.count() == 301
    plan = late._jdf.queryExecution().executedPlan().toString()
    once = plan.split("Union")[1].split("Window")[0]
    # In the branch of single keys the only shuffles are those of hashes and bitmaps.
    assert "wide" not in "".join(line for line in once.splitlines() if "Exchange" in line)


def test_nothing_to_collect(spark, tmp_path):
    source, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    (tmp_path / "in").mkdir()
    assert jobs.collect_lines(spark, source, table, progress)["held"].collect() == []
    (tmp_path / "in" / "hotel_1_reviews.jsonl").write_text(json.dumps({"id": 1}) + '\n{"id":2} {"id":3}\n{"id":4}x}\n', encoding="utf8")
    assert [tuple(r) for r in jobs.collect_lines(spark, source, table, progress)["held"].collect()] == [("1", 1)]
    empty_pages = str(tmp_path / "pages")
    spark.createDataFrame([], "hotel_id string, page_id long, html string").write.parquet(empty_pages)
    reports = jobs.collect_pages(spark, empty_pages, str(tmp_path / "none"))
    assert reports["run"].first().reviews_added == 0 and reports["remaining"].collect() == []


def test_null_ids_match_null_without_a_join(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("b", 4)], "review_id string, n int")
    for wanted, found in (([("a",), ("a",), (None,)], [1, 2, 3]), ([("b",)], [4]), ([], [])):
        wanted = spark.createDataFrame(wanted, "review_id string")
        assert sorted(r.n for r in splits.rows_of_ids(rows, wanted).collect()) == found
