from __future__ import annotations

import random

from pyspark.sql import functions as F

from kuchikomi.operators import sketches


def test_merged_quantiles_are_within_the_bound(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ABC"), rng.choice(["2023-01", "2023-02"]), "x" * int(rng.paretovariate(1.2) * 10 % 3000)) for _ in range(6000)] + [("A", "2023-01", None)]
    stored = sketches.length_sketches(spark.createDataFrame(rows, "hotel string, month string, t string").repartition(4), "t", ["hotel", "month"])
    assert stored.count() == 6
    for by in (["hotel"], []):
        for r in sketches.length_quantiles(sketches.merged_lengths(stored, by)).collect():
            own = sorted(len(t) for h, _, t in rows if t is not None and (not by or h == r.hotel))
            assert (r.n, r.min_chars, r.max_chars) == (len(own), own[0], own[-1])
            for name, share in (("p25", 0.25), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
                below, upto = sum(x < r[name] for x in own) / len(own), sum(x <= r[name] for x in own) / len(own)
                assert below - sketches.RANK_ERROR <= share <= upto + sketches.RANK_ERROR


def test_values_of_several_groups_count_once(spark):
    rows = spark.range(30_000).selectExpr("cast(id % 10000 as string) as id", "concat(repeat('y', 100), cast(id % 5000 as string)) as t", "cast(id % 3 as string) as hotel")
    stored = sketches.distinct_sketches(rows, ["id", "t"], ["hotel"])
    one = sketches.distinct_estimates(sketches.merged_distinct(stored, ["id", "t"], []), ["id", "t"]).first()
    assert abs(one.id / 10_000 - 1) < sketches.DISTINCT_ERROR and abs(one.t / 5_000 - 1) < sketches.DISTINCT_ERROR
    assert sketches.ids_against_texts(sketches.merged_distinct(stored, ["id", "t"], []), "id", "t").first().verdict == "texts repeat across ids"
    assert sketches.merged_distinct(stored.where("hotel = '9'"), ["id", "t"], ["hotel"]).collect() == []
    nulls = sketches.distinct_sketches(rows.select(F.lit(None).cast("string").alias("id"), "hotel"), ["id"], ["hotel"])
    assert {r.id for r in sketches.distinct_estimates(nulls, ["id"]).collect()} == {0}
