from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kuchikomi.operators import ranks, sampling, splits


def md5_order(key, seed=42):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest(), str(key)


def expected_split(keys):
    """The cut by sorting everything in one place."""
    ordered = sorted(set(keys), key=md5_order)
    n = len(ordered)
    held_out = math.ceil(0.2 * n)
    test = math.ceil(0.5 * held_out)
    return {k: "train" if i < n - held_out else "val" if i < n - test else "test" for i, k in enumerate(ordered)}


@pytest.fixture(scope="module")
def skewed(spark):
    """1000 rows, 82 % of one class, ids as text."""
    rows = [(f"r{i}", f"h{i % 25}", 2 if i % 100 < 82 else 1 if i % 100 < 95 else 0) for i in range(1000)]
    return spark.createDataFrame(rows, "review_id string, hotel_name string, sentiment_label int").repartition(6).cache()


@pytest.mark.parametrize("n", [1, 2, 5, 25, 35, 101])
def test_split_sizes_and_membership(spark, n):
    keys = [f"k{i}" for i in range(n)]
    rows = spark.createDataFrame([(k,) for k in keys * 3], "key string")
    found = splits.split_by(rows, "key").collect()
    assert len(found) == 3 * n
    assert {(r.key, r.split) for r in found} == set(expected_split(keys).items())


def test_twenty_five_hotels_split_20_2_3(skewed):
    report = {r.split: r for r in splits.split_report(splits.hotel_split(skewed)).collect()}
    assert {s: r.n_groups for s, r in report.items()} == {"train": 20, "val": 2, "test": 3}
    assert sum(r.n_rows for r in report.values()) == 1000
    assert all(r.label_0 + r.label_1 + r.label_2 == r.n_rows for r in report.values())


def test_no_group_is_in_two_splits_and_order_does_not_matter(skewed):
    first = splits.hotel_split(skewed)
    assert first.groupBy("hotel_name").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    shuffled = splits.hotel_split(skewed.orderBy(F.rand(7)).repartition(3))
    assert first.exceptAll(shuffled).count() == 0


def test_null_hotels_form_one_named_group(spark):
    rows = spark.createDataFrame([(None, i) for i in range(5)] + [("a", 9)], "hotel_name string, n int")
    found = splits.hotel_split(rows).collect()
    assert {r.hotel_name for r in found} == {"Unknown_Hotel", "a"}
    assert len({r.split for r in found if r.hotel_name == "Unknown_Hotel"}) == 1


def test_null_review_ids_stay_together(spark):
    rows = spark.createDataFrame([(None,)] * 5 + [(f"r{i}",) for i in range(20)], "review_id string")
    found = splits.review_split(rows).collect()
    assert len(found) == 25 and len({r.split for r in found if r.review_id is None}) == 1


def test_split_does_not_move_rows(skewed):
    """Rows are compared with a scalar; only distinct ids are shuffled, in subqueries."""
    plan = splits.review_split(skewed.select("review_id"))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_rank_equals_global_sort(skewed):
    found = ranks.with_rank(skewed, "review_id").collect()
    ordered = sorted((r.review_id for r in found), key=md5_order)
    assert {r.review_id: r["rank"] for r in found} == {k: i + 1 for i, k in enumerate(ordered)}


def test_rank_within_skewed_and_null_classes(spark):
    rows = [(i, None if i % 10 == 0 else i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "key int, label boolean").repartition(5)
    groups = defaultdict(list)
    for key, label in rows:
        groups[label].append(key)
    expected = {k: i + 1 for ks in groups.values() for i, k in enumerate(sorted(ks, key=md5_order))}
    found = ranks.with_rank(df, "key", ("label",), digits=2).collect()
    assert {r.key: r["rank"] for r in found} == expected


def test_stratified_split_cuts_every_class(skewed):
    found = splits.stratified_split(skewed, "review_id", "sentiment_label").collect()
    groups = defaultdict(list)
    for r in skewed.collect():
        groups[r.sentiment_label].append(r.review_id)
    expected = {}
    for keys in groups.values():
        train = len(keys) - math.ceil(0.2 * len(keys))
        expected |= {k: "train" if i < train else "val" for i, k in enumerate(sorted(keys, key=md5_order))}
    assert {r.review_id: r.split for r in found} == expected


def test_rows_of_ids_matches_null(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("a", 4)], "review_id string, n int")
    ids = spark.createDataFrame([("a",), (None,)], "review_id string")
    assert sorted(r.n for r in splits.rows_of_ids(rows, ids).collect()) == [1, 2, 4]


def test_routing(spark):
    rows = spark.createDataFrame([("train",), ("dev",), ("other",), (None,)], "split string")
    assert sorted(r.split for r in splits.routed(rows).collect()) == ["dev", "train"]


def test_weights(skewed):
    total = sampling.inverse_weights(skewed, "sentiment_label").groupBy("sentiment_label").agg(F.sum("weight").alias("w"))
    assert all(r.w == pytest.approx(1.0) for r in total.collect())


def _uniform(h, start):
    return int(h[start : start + 13], 16) / 2**52


def test_balanced_sample_against_direct_draws(skewed):
    groups = defaultdict(list)
    for r in skewed.collect():
        groups[r.sentiment_label].append(r.review_id)
    for keys in groups.values():
        keys.sort(key=md5_order)
    expected = {}
    for draw in range(1000):
        h = hashlib.md5(f"42|{draw}".encode()).hexdigest()
        keys = groups[sorted(groups)[math.floor(_uniform(h, 0) * 3)]]
        expected[draw] = keys[math.floor(_uniform(h, 13) * len(keys))]
    found = sampling.balanced_sample(skewed, "review_id", "sentiment_label").collect()
    assert len(found) == 1000
    assert {r.draw_id: r.review_id for r in found} == expected
    counts = Counter(r.sentiment_label for r in found)
    assert all(280 < n < 390 for n in counts.values())


def test_draws_are_laid_out_in_chunks(skewed, monkeypatch):
    monkeypatch.setattr(sampling, "DRAWS_PER_CHUNK", 64)
    ids = [r.draw_id for r in sampling.class_draws(skewed, "sentiment_label").collect()]
    assert sorted(ids) == list(range(1000))
    assert sampling.class_draws(skewed.limit(0), "sentiment_label").count() == 0


def test_batch_composition(skewed):
    found = sampling.batch_composition(skewed, "sentiment_label").collect()
    sizes = Counter()
    for r in found:
        sizes[r.batch] += r.n
    assert sizes == {b: 8 for b in range(20)}
    few = sampling.batch_composition(skewed.limit(10), "sentiment_label").agg(F.sum("n").alias("n")).first()
    assert few.n == 10


def test_capped_subset(skewed):
    found = sampling.capped_subset(skewed, "sentiment_label", ["review_id"], {2: 30, 1: 20, 0: 100}).collect()
    counts = Counter(r.sentiment_label for r in found)
    assert counts == {2: 30, 1: 20, 0: 50}
    positives = sorted(r.review_id for r in skewed.where("sentiment_label = 2").collect())
    assert sorted(r.review_id for r in found if r.sentiment_label == 2) == positives[:30]


def test_capped_subset_limits_before_the_shuffle(skewed):
    plan = sampling.capped_subset(skewed, "sentiment_label", ["review_id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_labels_outside_the_domain_are_kept_but_not_used(spark):
    rows = spark.createDataFrame([(i, [0, 1, 2, 9, None][i % 5]) for i in range(50)], "k int, label int")
    weighted = sampling.inverse_weights(rows, "label").collect()
    assert len(weighted) == 50 and {r.weight for r in weighted if r.label in (9, None)} == {None}
    split = splits.stratified_split(rows, "k", "label").collect()
    assert len(split) == 50 and {r.split for r in split if r.label in (9, None)} == {None}
    assert Counter(r.split for r in split if r.label == 1) == {"train": 8, "val": 2}
    assert {r.label for r in sampling.balanced_sample(rows, "k", "label").collect()} == {0, 1, 2}


def test_draws_are_never_broadcast(skewed):
    """The optimizer takes the expanded range for tiny; both sides must be shuffled on (class, rank)."""
    plan = sampling.balanced_sample(skewed, "review_id", "sentiment_label")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [sentiment_label" in plan


def test_rank_needs_one_shuffle_of_the_rows(skewed):
    rows = skewed.select("review_id", "sentiment_label", F.lit("payload").alias("comment"))
    plan = ranks.with_rank(rows, "review_id", ("sentiment_label",))._jdf.queryExecution().executedPlan().toString()
    big_side = plan.split("Join [_bucket")[1].split("Exchange")
    assert big_side[1].startswith(" hashpartitioning(_bucket") and "Window" in big_side[0]


def test_weighted_draws_follow_the_weights(spark):
    rows = [("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", None), ("e", float("nan")), ("f", -2.0), ("g", 4.0)]
    df = spark.createDataFrame(rows, "k string, w double")
    drawn = {r.k: r.n for r in sampling.weighted_draws(df, "k", "w", 20_000).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(drawn) == {"a", "b", "g"} and sum(drawn.values()) == 20_000
    for k, w in (("a", 1), ("b", 3), ("g", 4)):
        assert abs(drawn[k] / 20_000 - w / 8) < 0.015
    assert sampling.weighted_draws(df.where("w <= 0"), "k", "w", 5).collect() == [] == sampling.weighted_draws(df.limit(0), "k", "w").collect()


def test_weighted_draws_of_many_light_and_one_heavy_row(spark, monkeypatch):
    """Half the weight in one row, a third of the rows next to nothing: each draw takes the row its point lies on."""
    monkeypatch.setattr(sampling, "WEIGHT_BUCKETS", 16)
    df = spark.range(3000).selectExpr("cast(id as string) as k", "case when id = 7 then 2000.0D when id % 3 = 0 then 1e-9D else 1.0D end as w", "id")
    drawn = sampling.weighted_sample(df, "k", "w", 6000)
    assert drawn.columns == ["draw_id", "k", "w", "id"] and drawn.count() == drawn.select("draw_id").distinct().count() == 6000
    units = {r.k: r.u for r in df.select("k", sampling.weight_units(F.col("w"), F.lit(2000.0)).alias("u")).collect()}
    total, hashes = sum(units.values()), {k: hashlib.md5(f"{k}|42".encode()).hexdigest() for k in units}
    heavy = [k for k in units if units[k] * 16 >= total]
    line = sorted(units, key=lambda k: (k not in heavy, hashes[k][:3] if k not in heavy else "", hashes[k], k))
    ends = list(itertools.accumulate(units[k] for k in line))
    wanted = {d: line[bisect.bisect_right(ends, int(hashlib.md5(f"42|{d}".encode()).hexdigest()[:13], 16) * total >> 52)] for d in range(6000)}
    assert {r.draw_id: r.k for r in drawn.collect()} == wanted
    assert abs(sum(k == "7" for k in wanted.values()) / 6000 - 0.5) < 0.03
