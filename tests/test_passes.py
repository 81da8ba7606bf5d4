from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kuchikomi.operators import passes
from kuchikomi.operators.evaluation import macro_f1

SLOTS = 64


def rows(spark, n, seed=1):
    """Class 0 holds slot 5 or 6, class 1 slot 7, class 2 neither; all share noise. Most rows are of class 2."""
    rng, out = random.Random(seed), []
    for i in range(n):
        label = rng.choice([0, 1, 2, 2, 2, 2])
        mark = {0: [rng.choice([5, 6])], 1: [7, 7], 2: []}[label]
        out.append((str(i), 0, label, mark + [rng.randrange(10, SLOTS) for _ in range(4)], 1.0))
    return spark.createDataFrame(out, "review_id string, aspect_idx int, label int, slots array<int>, weight double")


def test_training_learns_and_keeps_every_state(spark, tmp_path):
    train, held_out = rows(spark, 400), rows(spark, 150, 2)
    best, reached = passes.train_in_passes(train, held_out, str(tmp_path), passes=4, slots=SLOTS)
    assert len(reached) == 4 and reached[best - 1] == max(reached) > 0.9
    for number, f1 in enumerate(reached, 1):
        state = passes.stored_state(spark, str(tmp_path), number, SLOTS)
        assert macro_f1(passes.scored(held_out, state)).first()["macro_f1"] == f1
    assert np.abs(passes.stored_state(spark, str(tmp_path), 1, SLOTS) - passes.stored_state(spark, str(tmp_path), 4, SLOTS)).max() > 0.1


def test_a_pass_is_the_average_of_plain_descents(spark):
    train, start = rows(spark, 60).repartition(3, "review_id").sortWithinPartitions("review_id"), np.random.default_rng(0).normal(size=(SLOTS, 3))
    found = passes.one_pass(train, start, 0.3)
    parts, total = np.zeros_like(start), 0
    for part in train.rdd.glom().collect():
        w = start.copy()
        for r in part:
            x = np.bincount(r.slots, minlength=SLOTS).astype(float)
            x /= np.sqrt((x * x).sum())
            e = np.exp(w.T @ x - (w.T @ x).max())
            slope = e / e.sum() - np.eye(3)[r.label]
            w -= 0.3 * np.outer(x, slope)
        parts += w * len(part)
        total += len(part)
    assert np.allclose(found, parts / total)


def test_nothing_to_learn_from(spark, tmp_path):
    train = rows(spark, 5).limit(0)
    odd = spark.createDataFrame([("a", 0, 1, [], 1.0), ("b", None, None, [3], None)], train.schema)
    best, reached = passes.train_in_passes(train, odd, str(tmp_path), passes=1, slots=SLOTS)
    assert best == 1 and len(reached) == 1 and passes.scored(odd, np.zeros((SLOTS, 3))).count() == 2
    assert not passes.one_pass(odd, np.zeros((SLOTS, 3)), 0.1).any()


def test_slots_are_hashed_by_kind(spark):
    schema = "review_id string, aspect_idx int, aspect_category int, label int, chars array<string>, subwords array<string>, words array<string>"
    made = spark.createDataFrame([("a", 0, 0, 1, ["x", "y", "x"], ["x"], ["x"]), ("b", 0, 8, 1, [], [], []), ("c", 0, 8, 1, ["x"], None, None)], schema)
    found = {r.review_id: r.slots for r in passes.prepared(made, 1 << 20).collect()}
    assert len(set(found["a"])) == len(found["a"]) == 6 and len(found["b"]) == 1 and found["c"] == []
    assert passes.prepared(made.withColumn("weight", F.lit(2.0)), 8).columns == ["review_id", "aspect_idx", "label", "weight", "slots"]


@pytest.mark.parametrize("weight", [0.0, 3.0])
def test_weights_scale_steps(spark, weight):
    one = spark.createDataFrame([("a", 0, 0, [1], weight)], rows(spark, 1).schema)
    out = passes.one_pass(one, np.zeros((SLOTS, 3)), 0.1)
    assert np.allclose(out[1], -0.1 * weight * np.array([1 / 3 - 1, 1 / 3, 1 / 3])) and not np.delete(out, 1, axis=0).any()


def test_slots_are_hashed_in_tasks_for_many_rows_at_once(spark):
    schema = "review_id string, aspect_idx int, aspect_category int, label int, chars array<string>, subwords array<string>, words array<string>"
    made = spark.createDataFrame([("a", 0, 0, 1, ["x", "y", "x", "y"], ["xy"], ["xy", "z"]), ("b", 0, 0, 1, ["x", "y"], [], ["z"]), ("c", 0, None, 1, [], [], [])], schema)
    slots = passes.prepared(made.coalesce(1), 1 << 20)
    assert "zip_with" not in slots._jdf.queryExecution().optimizedPlan().toString()
    found = {r.review_id: r.slots for r in slots.collect()}
    # xy, yx, xy, y; the subword; two words; the aspect. The other row shares a pair, the last character, a word and the aspect.
    assert len(found["a"]) == 8 and found["a"][0] == found["a"][2] and len(set(found["a"])) == 7
    assert found["b"] == [found["a"][0], found["a"][3], found["a"][6], found["a"][7]] and found["c"] == []
