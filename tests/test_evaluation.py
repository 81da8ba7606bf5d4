from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kuchikomi.operators import classifier, evaluation, vocabulary

# Published outcome of one validation run: diagonal and class sizes.
DIAGONAL, SUPPORT = (49, 298, 3622), (130, 647, 5147)


def f1_by_hand(pairs):
    classes = {t for t, _ in pairs} | {p for _, p in pairs}
    scores = []
    for c in classes:
        hit = sum(t == p == c for t, p in pairs)
        scores.append(2 * hit / (sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)))
    return sum(scores) / len(scores)


def frame(spark, rows):
    return spark.createDataFrame(rows, "aspect_idx int, label int, predicted int")


def test_published_confusion(spark):
    rows = []
    for k in range(3):
        rows += [(0, k, k)] * DIAGONAL[k] + [(0, k, (k + 1) % 3)] * (SUPPORT[k] - DIAGONAL[k])
    df = frame(spark, rows)
    cells = {(r.true_label, r.pred_label): r.n for r in evaluation.confusion_matrix(df).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 5924
    assert [cells[k, k] for k in range(3)] == list(DIAGONAL) and cells[0, 2] == 0
    assert evaluation.accuracy(df).first().accuracy == pytest.approx(3969 / 5924)
    assert evaluation.macro_f1(df).first().macro_f1 == pytest.approx(f1_by_hand([r[1:] for r in rows]))


def test_macro_f1_counts_only_classes_seen(spark):
    df = frame(spark, [(0, 2, 2), (0, 2, 2), (0, 1, 2), (3, 2, 2), (-1, 0, 1)])
    found = {r.aspect: r.macro_f1 for r in evaluation.aspect_macro_f1(df).collect()}
    assert found == {"room": pytest.approx(0.4), "bath": 1.0, "-1": 0.0}


def test_report_against_hand_values(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(8), rng.choice([0, 1, 2, 2, 2]), rng.choice([0, 1, 2, 2])) for _ in range(500)]
    found = {r.metric: r.value for r in evaluation.metric_report(frame(spark, rows)).collect()}
    assert found["accuracy"] == pytest.approx(sum(t == p for _, t, p in rows) / 500)
    assert found["macro_f1"] == pytest.approx(f1_by_hand([r[1:] for r in rows]))
    assert found["macro_f1_bath"] == pytest.approx(f1_by_hand([r[1:] for r in rows if r[0] == 3]))
    assert len(found) == 10


def test_classifier_learns_stores_and_reloads(spark, tmp_path):
    words = {0: "最悪 汚い 狭い", 1: "普通 まあまあ", 2: "最高 綺麗 広い"}
    rng = random.Random(5)
    rows = [
        (str(i), rng.choice(["room", "bath", "spa"]), " ".join(rng.choices(words[k].split(), k=4)), k)
        for i, k in enumerate([0] * 20 + [1] * 30 + [2] * 80)
    ]
    df = spark.createDataFrame(rows, "review_id string, aspect string, comment string, sentiment_label int")
    table = vocabulary.train_vocabulary(df, "comment", size=60).cache()
    examples = classifier.examples(df, table).cache()
    path = str(tmp_path / "model")
    train, held_out = examples.where(F.col("review_id") % 4 != 0), examples.where(F.col("review_id") % 4 == 0)
    model, best = classifier.select_model(train, held_out, path, grid=(0.01, 100.0), features=256, max_iter=10)
    assert best > 0.95
    again = classifier.score(classifier.load_model(spark, path), held_out)
    assert again.select("review_id", "predicted").exceptAll(classifier.score(model, held_out).select("review_id", "predicted")).count() == 0
    assert again.columns == ["review_id", "logits", "aspect_idx", "label", "predicted"]
