from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from kuchikomi.operators import trends
from kuchikomi.streaming import trend_table

SCHEMA = "hotel_name string, review_id string, aspect string, year_month string, score double, sentiment_label int"


def rows(rng, n, months):
    return [(rng.choice(["A", "B", None]), str(rng.random()), rng.choice(["room", "bath"]), rng.choice(months), rng.choice([None, 1.0, 2.5, 5.0]), rng.choice([None, 0, 1, 2])) for _ in range(n)]


def key(row):
    return tuple((v is None, v) for v in row)


def test_deliveries_add_up_to_the_whole(spark, tmp_path):
    rng, whole, table = random.Random(5), [], str(tmp_path / "t")
    months = [f"2023-{m:02d}" for m in range(1, 13)]
    for part in (rows(rng, 60, months), [], rows(rng, 40, months[3:5]), rows(rng, 6, ["2022-07", "2024-01"]), rows(rng, 80, months)):
        whole += part
        trend_table.update_both_levels(spark.createDataFrame(part, SCHEMA), table, min_reviews=3)
        wanted = trends.trends_of_both_levels(spark.createDataFrame(whole, SCHEMA), min_reviews=3)
        for level, expected in zip(("global", "hotel"), wanted):
            kept = trend_table.kept_trend(spark, f"{table}/{level}").select(*expected.columns)
            assert sorted(map(tuple, kept.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)


def test_untouched_months_are_not_written(spark, tmp_path):
    table, months = str(tmp_path / "t"), [f"2023-{m:02d}" for m in range(1, 9)]
    first = [("A", f"{m}{i}", "room", m, 3.0, 1) for m in months for i in range(5)] + [("B", f"{m}{i}", "room", m, 4.0, 2) for m in ("2023-03", "2023-08") for i in range(5)]
    sums = trends.month_sums(spark.createDataFrame(first, SCHEMA), ("hotel_name",))
    assert trend_table.update(sums, table, ("hotel_name",)) == months
    before = {p: p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet")}
    late = trends.month_sums(spark.createDataFrame([("B", "late", "room", "2023-03", 1.0, 0)], SCHEMA), ("hotel_name",))
    # The month itself, and for its hotel the next one there is, whose change refers to it.
    assert trend_table.update(late, table, ("hotel_name",)) == ["2023-03", "2023-08"]
    assert {p: p.stat().st_mtime_ns for p in before} == before
    _, parts = trend_table.manifest(spark, table)
    assert [m for m, d in parts["sums"].items() if d == 2] == ["2023-03"]
    assert sorted(m for m, d in parts["trend"].items() if d == 2) == ["2023-03", "2023-08"]
    changed = trend_table.kept_trend(spark, table).where("hotel_name = 'B'").orderBy("year_month").collect()
    assert [(r.review_count, r.avg_score, r.score_delta) for r in changed] == [(6, 3.5, None), (5, 4.0, 0.5)]


def test_an_unfinished_delivery_leaves_the_trend_as_it_was(spark, tmp_path):
    table = str(tmp_path / "t")
    whole = spark.createDataFrame([("A", str(i), "room", "2023-01", 2.0, 1) for i in range(6)], SCHEMA)
    trend_table.update(trends.month_sums(whole), table)
    whole.select("aspect", F.lit(99).alias("review_count")).write.parquet(f"{table}/sums/delivery=2/year_month=2023-01")
    assert trend_table.kept_trend(spark, table).first().review_count == 6
    trend_table.update(trends.month_sums(whole), table)
    assert trend_table.kept_trend(spark, table).first().review_count == 12
